"""Queries of the document-analytics operators over the driver's tables, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import similarity as S
from tesserae.functions import text as T
from tesserae.operators import asof, catalog, chunking, evaluation, evidence, index, opspec, tables
from tesserae.plans import guard, router
from tesserae.runtime import settle, ship, table
from tesserae.streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def note(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return note


# -- the tokenizer in DuckDB's SQL ---------------------------------------------------------------
_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def duck_tokens(text: str) -> str:
    plain = text
    for _ in range(2):
        plain = rf"regexp_replace({plain}, '([0-9]),([0-9]{{3}})\b', '\1\2', 'g')"
    raw = rf"regexp_extract_all({plain}, '[\p{{L}}\p{{N}}\p{{M}}_]+(?:[-./''][\p{{L}}\p{{N}}\p{{M}}_]+)*')"
    parts = r"list_filter(regexp_split_to_array(regexp_replace(raw, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[-./_'']'), lambda p: p <> '')"
    whole = f"flatten(list_transform({raw}, lambda raw: CASE WHEN len({parts}) = 1 THEN [raw] ELSE list_prepend(raw, {parts}) END))"
    kept = (
        f"list_filter(list_transform({whole}, lambda t: lower(t)), "
        f"lambda t: t NOT IN ({_STOPS}) AND (length(t) > 1 OR regexp_matches(t, '^[0-9]$')))"
    )
    letters = r"length(t) > 4 AND regexp_matches(t, '^\p{L}+$')"
    return (
        f"list_transform({kept}, lambda t: CASE WHEN {letters} AND t LIKE '%ies' THEN left(t, length(t) - 3) || 'y' "
        f"WHEN {letters} AND t LIKE '%s' AND NOT regexp_matches(t, '(ss|us|is)$') THEN left(t, length(t) - 1) ELSE t END)"
    )


_POSTINGS = f"""
tok AS (SELECT doc_id AS id, {duck_tokens("coalesce(text, '')")} AS t FROM documents),
tf AS (SELECT id, len(t) AS n, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM tok) GROUP BY id, n, term),
post AS (SELECT id, term, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 256.0)) AS weight FROM tf),
q AS (SELECT DISTINCT item_id AS qid, unnest({duck_tokens("coalesce(text, '')")}) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM q) GROUP BY term)
"""


def _postings(spark, d, terms=None):
    return index.postings(table(spark, d, "documents"), "doc_id", "text", terms)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search: BM25 and hashed vectors over the documents for every benchmark item, fused,
    with at most three hits a source. Texts are tokenised once, for both indexes."""
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    tokens = settle(index.token_table(docs, "doc_id", "text"), "search-tokens")
    terms = index.query_terms(asked, "item_id", "text")
    sparse = index.sparse_topk(index.postings(tokens, "id", "tokens", terms), terms, docs.count(), 30)
    vectors = index.hash_embedding(tokens, "id", "tokens")
    wanted = index.hash_embedding(asked, "item_id", "text").select(F.col("id").alias("qid"), F.col("embedding").alias("q"))
    hits = index.search(index.dense_topk(vectors, wanted, 30), sparse, "hybrid", 30)
    placed = hits.join(docs.select(F.col("doc_id").alias("id"), "source"), "id")
    kept = index.diversify(placed, per_document=3, top=6, doc_col="source")
    return kept.select("qid", F.col("id").alias("doc_id"), "place", "score", "dense_rank", "sparse_rank")


@_query()
def hybrid_search(spark, d):
    return flagship(spark, d)


# -- catalog, scans and joins --------------------------------------------------------------------
@_query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000")
def scan_filter_project(spark, d):
    o = table(spark, d, "orders")
    return o.filter("o_orderstatus = 'O' AND o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_totalprice")


@_query(
    "SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name"
)
def catalog_inner_join(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return (
        c.groupBy("c_nationkey").agg(F.count("*").alias("customers"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_name", "r_name", "customers")
    )


@_query("SELECT doc_id, toxic, source AS file_name FROM labels JOIN documents USING (doc_id)")
def catalog_documents_inner(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("source", "file_name")
    return catalog.with_documents(table(spark, d, "labels"), docs).select("doc_id", "toxic", "file_name")


@_query("SELECT item_id AS doc_id, coalesce(source, '') AS file_name FROM (SELECT item_id * 3 AS item_id FROM benchmark) LEFT JOIN documents ON doc_id = item_id")
def catalog_documents_left(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("source", "file_name")
    return catalog.with_documents(table(spark, d, "benchmark").select((F.col("item_id") * 3).alias("doc_id")), docs, "left")


@_query(
    "SELECT conv_id AS thread_id, 'thread ' || conv_id AS title, min(turn) AS created_at, max(turn) AS updated_at FROM conversations GROUP BY conv_id"
)
def thread_upsert(spark, d):
    """First turns as known threads, later turns as touches."""
    c = table(spark, d, "conversations")
    first = c.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    rows = lambda df: df.select(
        F.col("conv_id").alias("thread_id"), F.concat(F.lit("thread "), "conv_id").alias("title"), F.col("turn").alias("created_at"), F.col("turn").alias("updated_at")
    )
    return catalog.touch_threads(rows(first), rows(c))


@_query(
    "WITH known AS (SELECT conv_id AS thread_id, turn, turn * 10 AS idx FROM conversations WHERE turn < 2), top AS (SELECT thread_id, max(idx) AS m FROM known GROUP BY 1) "
    "SELECT thread_id, idx FROM known UNION ALL SELECT conv_id, coalesce(m, -1) + row_number() OVER (PARTITION BY conv_id ORDER BY turn) "
    "FROM conversations LEFT JOIN top ON conv_id = thread_id WHERE turn >= 2"
)
def messages_append(spark, d):
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "thread_id")
    known = c.where("turn < 2").select("thread_id", "turn", (F.col("turn") * 10).alias("idx"))
    return catalog.append_messages(known, c.where("turn >= 2").select("thread_id", "turn"), "turn").select("thread_id", "idx")


@_query("SELECT role, count(*) AS n FROM conversations WHERE conv_id % 7 <> 0 GROUP BY role")
def threads_delete(spark, d):
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "thread_id")
    threads = c.select("thread_id").distinct()
    return catalog.delete_threads(threads, c, threads.where("thread_id % 7 = 0"))[1].groupBy("role").agg(F.count("*").alias("n"))


@_query(
    "SELECT replace(p_type, ' ', '.') AS name FROM part UNION SELECT list_last(string_split(p_type, ' ')) FROM part"
)
def symbol_name_set(spark, d):
    return catalog.symbol_names(table(spark, d, "part").select(F.replace("p_type", F.lit(" "), F.lit(".")).alias("symbol")))


@_query(
    "SELECT p_partkey AS doc_id, replace(p_type, ' ', '.') AS symbol FROM part WHERE regexp_replace(p_type, '^[^ ]* ', '') IN "
    "(SELECT min(regexp_replace(p_type, '^[^ ]* ', '')) FROM part)"
)
def symbols_found(spark, d):
    """Parts as documents whose symbol is their type; found by the part of the name after the first dot."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.replace("p_type", F.lit(" "), F.lit(".")).alias("symbol"))
    wanted = p.agg(F.min(F.expr("substring(symbol, instr(symbol, '.') + 1)"))).first()[0]
    return catalog.find_symbols(p, [wanted])


@_query(
    "SELECT count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chunks, CAST(sum(doc_id % 3) AS BIGINT) AS tables, CAST(sum(doc_id % 11) AS BIGINT) AS pages "
    "FROM documents JOIN labels USING (doc_id) WHERE quality = 1"
)
def library_counts(spark, d):
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    status = F.when(F.col("quality") == 1, "ready").otherwise("error")
    return catalog.library_totals(
        both.select(status.alias("status"), F.col("n_chars").alias("chunks"), (F.col("doc_id") % 3).alias("tables"), (F.col("doc_id") % 11).alias("pages"))
    )


@_query(
    "SELECT p_partkey, CAST(p_size AS VARCHAR) || ',' || CAST(p_partkey % 9 AS VARCHAR) || ',7' AS cited, 'Size ' || p_size || ', see.' AS bare FROM part"
)
def citation_ids(spark, d):
    p = table(spark, d, "part")
    said = F.format_string("Size %d [S%d, %d], see [ s7 ][S7].", "p_size", "p_size", F.col("p_partkey") % 9)
    said = F.replace(said, F.lit("[ s7 ]"), F.lit(""))
    return p.select("p_partkey", F.array_join(T.cited_ids(said), ",").alias("cited"), T.strip_citations(said).alias("bare"))


@_query(
    "SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(a)), 6) AS coverage FROM "
    "(SELECT p_partkey, string_split(p_type, ' ') AS a, string_split(p_name || ' ' || lower(p_type) || ' ' || left(p_type, 5), ' ') AS b FROM part)"
)
def claim_coverage(spark, d):
    both = F.concat_ws(" ", "p_name", F.lower("p_type"), F.left("p_type", F.lit(5)))
    return table(spark, d, "part").select("p_partkey", F.round(T.term_coverage(F.split("p_type", " "), F.split(both, " ")), 6).alias("coverage"))


@_query(
    "SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slugged, "
    "round(1 / (1 + exp(-greatest(-30, least(30, c_acctbal / 100)))), 9) AS squashed, regexp_full_match(CAST(c_custkey AS VARCHAR), '(19|20)[0-9][0-9]') AS is_year FROM customer"
)
def text_helpers(spark, d):
    c = table(spark, d, "customer")
    return c.select(
        "c_custkey", T.slug(F.concat_ws(" / ", "c_name", "c_mktsegment")).alias("slugged"),
        F.round(T.sigmoid(F.col("c_acctbal") / 100), 9).alias("squashed"), T.is_year(F.col("c_custkey").cast("string")).alias("is_year"),
    )


@_query(
    "SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN "
    "(SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey"
)
def catalog_left_join(spark, d):
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@_query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def semi_scope(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").filter("toxic = 0"), "doc_id", "left_semi")


@_query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_unlabelled(spark, d):
    return catalog.delete(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), ["doc_id"])


@_query(
    "SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey "
    "AND l_quantity <= p_size + 10 AND p_size <= l_quantity + 5 GROUP BY p_brand"
)
def range_join_interval(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("a"), (F.col("l_quantity") + 5).alias("b"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_brand", F.col("p_size").alias("c"), (F.col("p_size") + 10).alias("e"))
    return index.interval_join(li, p, "k", ("a", "b"), ("c", "e")).groupBy("p_brand").agg(F.count("*").alias("n"))


@_query("SELECT doc_hash, count(*) AS copies, min(doc_id) AS kept FROM (SELECT doc_id, substr(sha256(text), 1, 16) AS doc_hash FROM documents) GROUP BY doc_hash")
def dedup_content_hash(spark, d):
    rows = table(spark, d, "documents").select("doc_id", catalog.content_id("text").alias("doc_hash"))
    return rows.groupBy("doc_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("kept"))


@_query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS idx FROM conversations")
def thread_turn_index(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", (F.row_number().over(w) - 1).cast("long").alias("idx"))


@_query(
    "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS n FROM conversations) WHERE n = 1"
)
def latest_per_thread(spark, d):
    return catalog.latest(table(spark, d, "conversations"), ["conv_id"], ["turn", "role", "text"]).select("conv_id", "turn", "role")


@_query("SELECT conv_id, max(turn) AS last_turn, count(*) AS messages FROM conversations GROUP BY conv_id ORDER BY messages DESC, conv_id LIMIT 20")
def recent_threads_topk(spark, d):
    per = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("messages"))
    return per.orderBy(F.col("messages").desc(), "conv_id").limit(20)


@_query(
    "SELECT conv_id, turn, role, string_agg(left(text, 400), ' / ') OVER (PARTITION BY conv_id ORDER BY turn, role, text "
    "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS history FROM conversations"
)
def last_turns_window(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(-2, 0)
    parts = F.collect_list(F.substring("text", 1, 400)).over(w)
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.array_join(parts, " / ").alias("history"))


@_query()
def upsert_documents(spark, d):
    """Documents with the labelled ones replaced by their upper-cased version."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.lit(1).alias("version"))
    new = docs.join(table(spark, d, "labels"), "doc_id", "left_semi").withColumn("version", F.lit(2))
    return catalog.upsert(docs, new, ["doc_id"])


_SQL["upsert_documents"] = (
    "SELECT doc_id, lang, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 2 ELSE 1 END AS version FROM documents"
)


# -- op-specs, guarded SQL, tables ---------------------------------------------------------------
@_query(
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(l_orderkey) AS n, max(l_tax) AS top_tax FROM lineitem "
    "WHERE l_discount >= 0.05 AND l_returnflag <> 'N' GROUP BY 1, 2 ORDER BY qty DESC LIMIT 3"
)
def opspec_group_sort_limit(spark, d):
    spec = opspec.OpSpec(
        table="lineitem",
        filters=[{"column": "l_discount", "op": ">=", "value": 0.05}, {"column": "l_returnflag", "op": "!=", "value": "n"}],
        group_by=["l_returnflag", "l_linestatus"],
        aggregations=[
            {"column": "l_quantity", "func": "sum", "alias": "qty"},
            {"column": "l_orderkey", "func": "count", "alias": "n"},
            {"column": "l_tax", "func": "max", "alias": "top_tax"},
        ],
        sort=[{"column": "qty", "descending": True}],
        limit=3,
    )
    return opspec.run_spec(spec, table(spark, d, "lineitem"))


_GUARDED = {
    "sql_guarded_select": (
        'SELECT "o_orderpriority" AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders '
        "WHERE o_orderpriority ILIKE '%e%' GROUP BY 1 ORDER BY 1"
    ),
    "sql_cte": (
        "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey) "
        "SELECT c_mktsegment, count(*) AS n, round(max(spent), 2) AS most FROM big JOIN customer ON c_custkey = o_custkey "
        "GROUP BY c_mktsegment ORDER BY c_mktsegment"
    ),
    "sql_window_rank": (
        "SELECT n_name, s_name, place FROM (SELECT n_name, s_name, row_number() OVER (PARTITION BY n_name ORDER BY s_acctbal DESC, s_name) AS place "
        "FROM supplier JOIN nation ON s_nationkey = n_nationkey) AS r WHERE place <= 2 ORDER BY n_name, place"
    ),
    "sql_setops": (
        "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey AS k FROM supplier "
        "EXCEPT SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1 ORDER BY k"
    ),
    "sql_cube_rollup": (
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority) "
        "ORDER BY o_orderstatus NULLS LAST, o_orderpriority NULLS LAST"
    ),
    "sql_date_parts": (
        "SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(EXTRACT(quarter FROM o_orderdate) AS INT) AS quarter, count(*) AS n "
        "FROM orders GROUP BY 1, 2 ORDER BY 1"
    ),
    "sql_subquery_filter": (
        "SELECT p_brand, count(*) FILTER (WHERE p_size > 25) AS big, count(*) AS n FROM part "
        "WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part) AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey) "
        "GROUP BY p_brand HAVING count(*) > 1 ORDER BY p_brand"
    ),
}


#: Statements whose functions DuckDB names differently, each with its form there.
_TRANSLATED = {
    "sql_unnest": (
        "SELECT word, count(*) AS n FROM (SELECT explode(split(p_type, ' ')) AS word FROM part) AS w GROUP BY word ORDER BY word",
        "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part) AS w GROUP BY word",
    ),
    "sql_statistics": (
        "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_tax), 8) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r, "
        "round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS q1, "
        "listagg(DISTINCT l_linestatus, ',') WITHIN GROUP (ORDER BY l_linestatus) AS statuses FROM lineitem GROUP BY l_returnflag ORDER BY l_returnflag",
        "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_tax), 8) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r, "
        "round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, "
        "string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS statuses FROM lineitem GROUP BY l_returnflag",
    ),
    "sql_pivot": (
        "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders) PIVOT (max(o_totalprice) FOR o_orderstatus IN "
        "('F' AS f, 'O' AS o, 'P' AS p)) ORDER BY o_orderpriority",
        "FROM (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders) PIVOT (max(o_totalprice) FOR o_orderstatus IN "
        "('F' AS f, 'O' AS o, 'P' AS p) GROUP BY o_orderpriority)",
    ),
    "sql_strings": (
        "SELECT n_name, levenshtein(n_name, 'FRANCE') AS steps, sha2(n_name, 256) AS digest, md5(lower(n_name)) AS m, split_part(n_name, ' ', 1) AS word, "
        "lpad(left(n_name, 3), 6, '*') AS padded, regexp_replace(n_name, '[AEIOU]+', '-') AS bare, reverse(n_name) AS turned FROM nation ORDER BY n_name",
        "SELECT n_name, levenshtein(n_name, 'FRANCE') AS steps, sha256(n_name) AS digest, md5(lower(n_name)) AS m, split_part(n_name, ' ', 1) AS word, "
        "lpad(left(n_name, 3), 6, '*') AS padded, regexp_replace(n_name, '[AEIOU]+', '-', 'g') AS bare, reverse(n_name) AS turned FROM nation",
    ),
    "sql_arrays": (
        "SELECT p_type, array_join(transform(split(p_type, ' '), x -> upper(left(x, 2))), '/') AS short, "
        "size(filter(split(p_type, ' '), x -> length(x) > 5)) AS wide, aggregate(transform(split(p_type, ' '), x -> length(x)), 0, (a, x) -> a + x) AS letters, "
        "array_join(array_sort(array_distinct(split(p_type, ' '))), ' ') AS sorted FROM (SELECT DISTINCT p_type FROM part) AS t ORDER BY p_type",
        "SELECT p_type, array_to_string(list_transform(string_split(p_type, ' '), lambda x: upper(left(x, 2))), '/') AS short, "
        "len(list_filter(string_split(p_type, ' '), lambda x: length(x) > 5)) AS wide, CAST(list_sum(list_transform(string_split(p_type, ' '), lambda x: length(x))) AS BIGINT) AS letters, "
        "array_to_string(list_sort(list_distinct(string_split(p_type, ' '))), ' ') AS sorted FROM (SELECT DISTINCT p_type FROM part) AS t ORDER BY p_type LIMIT 200",
    ),
    "sql_maps_structs": (
        "SELECT r_name, m['key'] AS k, array_join(map_keys(m), ',') AS names, s.first_letter AS letter, map_contains_key(m, 'none') AS has_none FROM "
        "(SELECT r_name, map_from_arrays(array('key', 'size'), array(r_regionkey, length(r_name))) AS m, named_struct('first_letter', left(r_name, 1)) AS s FROM region) AS t "
        "ORDER BY r_name",
        "SELECT r_name, m['key'] AS k, array_to_string(map_keys(m), ',') AS names, s.first_letter AS letter, map_contains(m, 'none') AS has_none FROM "
        "(SELECT r_name, map(['key', 'size'], [r_regionkey, length(r_name)]) AS m, struct_pack(first_letter := left(r_name, 1)) AS s FROM region) AS t",
    ),
    "sql_json": (
        "SELECT event_type, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS total, count(get_json_object(props, '$.missing')) AS missing "
        "FROM events GROUP BY event_type ORDER BY event_type",
        "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(json_extract_string(props, '$.missing')) AS missing "
        "FROM events GROUP BY event_type",
    ),
    "sql_sample": (
        "SELECT o_orderstatus, count(*) AS n FROM orders TABLESAMPLE (100 PERCENT) GROUP BY o_orderstatus ORDER BY o_orderstatus",
        "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
    ),
}
_GUARDED |= {
    "sql_full_join": (
        "SELECT coalesce(c.k, s.k) AS k, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 "
        "GROUP BY c_nationkey) AS c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) AS s "
        "ON c.k = s.k ORDER BY k"
    ),
    "sql_right_join": (
        "SELECT n_name, count(s_suppkey) AS suppliers FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal < 1000 "
        "GROUP BY n_name ORDER BY n_name"
    ),
    "sql_cross_join": (
        "SELECT a.r_name AS left_name, b.r_name AS right_name FROM region AS a CROSS JOIN region AS b WHERE a.r_name < b.r_name ORDER BY left_name, right_name"
    ),
    "sql_lateral": (
        "SELECT n_name, t.s_name, t.s_acctbal FROM nation, LATERAL (SELECT s_name, s_acctbal FROM supplier WHERE s_nationkey = n_nationkey "
        "ORDER BY s_acctbal DESC, s_name LIMIT 1) AS t ORDER BY n_name"
    ),
    "sql_approximate": (
        "SELECT o_orderpriority, abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) <= 0.25 * count(DISTINCT o_custkey) AS near "
        "FROM orders GROUP BY o_orderpriority ORDER BY o_orderpriority"
    ),
    "sql_grouping_sets": (
        "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS g, count(*) AS n FROM lineitem "
        "GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ()) ORDER BY g, n"
    ),
    "sql_ranking": (
        "SELECT s_name, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(3) OVER (PARTITION BY s_nationkey % 5 ORDER BY s_acctbal, s_name) AS third, "
        "round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM supplier "
        "WINDOW w AS (PARTITION BY s_nationkey % 5 ORDER BY s_nationkey) ORDER BY s_name LIMIT 150"
    ),
    "sql_lag_lead": (
        "SELECT y, o_orderstatus, n, lag(n) OVER w AS before, lead(n, 1, 0) OVER w AS later, first_value(n) OVER w AS opening, "
        "nth_value(n, 2) OVER w AS second_n FROM (SELECT CAST(EXTRACT(year FROM o_orderdate) AS INT) AS y, o_orderstatus, count(*) AS n FROM orders "
        "GROUP BY 1, 2) AS t WINDOW w AS (PARTITION BY o_orderstatus ORDER BY y) ORDER BY o_orderstatus, y"
    ),
    "sql_qualify": (
        "SELECT n_regionkey, n_name FROM nation WHERE n_name <> 'none' QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) <= 2 ORDER BY n_name"
    ),
    "sql_distinct_on": (
        "SELECT DISTINCT ON (s_nationkey) s_nationkey, s_name, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_name"
    ),
    "sql_offset": "SELECT n_name FROM nation ORDER BY n_name LIMIT 5 OFFSET 3",
    "sql_recursive": (
        "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t ORDER BY n"
    ),
    "sql_unpivot": (
        "SELECT name, round(sum(v), 2) AS total FROM (SELECT l_quantity, l_tax, l_discount FROM lineitem) UNPIVOT (v FOR name IN (l_quantity, l_tax, l_discount)) "
        "GROUP BY name ORDER BY name"
    ),
    "sql_math": (
        "SELECT n_nationkey, round(sqrt(n_nationkey), 9) AS root, round(ln(n_nationkey + 1), 9) AS natural, round(log10(n_nationkey + 1), 9) AS decimal, "
        "round(pow(1.5, n_regionkey), 6) AS grown, mod(n_nationkey, 7) AS rest, CAST(sign(n_nationkey - 12) AS INT) AS side, "
        "greatest(n_nationkey, 10) AS top, least(n_nationkey, n_regionkey) AS low, CAST(floor(n_nationkey / 4.0) AS BIGINT) AS quarters "
        "FROM nation ORDER BY n_nationkey"
    ),
}


def _guarded(name: str, sql: str, duck: str | None = None) -> None:
    import re

    names = [t for t in ("orders", "customer", "supplier", "nation", "part", "lineitem", "region", "events") if re.search(rf"\b{t}\b", sql)]

    def run(spark, d):
        with guard.Sandbox(spark, {t: table(spark, d, t) for t in names}) as box:
            return box.frame(sql)

    _QUERIES[name], _SQL[name] = run, duck or sql


for _n, _s in _GUARDED.items():
    _guarded(_n, _s)
for _n, (_s, _d) in _TRANSLATED.items():
    _guarded(_n, _s, _d)


@_query(
    "SELECT e.event_id, CAST(epoch_us(v.ts) AS BIGINT) AS seen FROM (SELECT * FROM events WHERE event_type = 'error') AS e "
    "ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') AS v ON e.user_id = v.user_id AND e.ts >= v.ts"
)
def asof_last_view(spark, d):
    """For each error the user's latest view at or before it."""
    e = table(spark, d, "events")
    joined = asof.asof_join(e.where("event_type = 'error'"), e.where("event_type = 'view'"), ["user_id"], "ts", width=86400.0, columns=["event_id"])
    return joined.select("event_id", F.unix_micros(F.col("matched.ts").cast("timestamp")).alias("seen"))


@_query(
    "SELECT name, count(*) FILTER (WHERE v IS NULL) AS nulls, count(DISTINCT v) AS distinct_values, round(avg(v), 2) AS mean FROM ("
    "SELECT 'l_quantity' AS name, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem "
    "UNION ALL SELECT 'l_tax', l_tax FROM lineitem) GROUP BY name"
)
def profile_numeric(spark, d):
    p = tables.profile(table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax"))
    return p.select("name", "nulls", F.col("distinct").alias("distinct_values"), "mean")


@_query(
    "SELECT name, value, n, place FROM (SELECT name, value, n, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS place FROM ("
    "SELECT 'p_brand' AS name, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand UNION ALL "
    "SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type)) WHERE place <= 6"
)
def profile_text_topk(spark, d):
    return tables.top_values(table(spark, d, "part"), ["p_brand", "p_type"])


_MONEY = (
    "CASE o_orderkey % 4 WHEN 0 THEN concat('$', CAST(o_orderkey // 1000 AS VARCHAR), ',', lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0')) "
    "WHEN 1 THEN concat('(', CAST(o_orderkey AS VARCHAR), ')') WHEN 2 THEN concat(CAST(o_orderkey AS VARCHAR), '%') ELSE 'n/a' END"
)


@_query(
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS DOUBLE) WHEN 1 THEN -CAST(o_orderkey AS DOUBLE) "
    "WHEN 2 THEN CAST(o_orderkey AS DOUBLE) END AS amount FROM orders"
)
def coerce_text_numbers(spark, d):
    money = F.expr(_MONEY.replace("//", "DIV").replace("VARCHAR", "STRING"))
    return table(spark, d, "orders").select("o_orderkey", T.parse_number(money).alias("amount"))


@_query(
    "SELECT label, n, label LIKE 'Total%' OR label LIKE 'Subtotal%' AS is_total FROM (SELECT CASE WHEN o_orderstatus IS NULL THEN 'Total' "
    "WHEN o_orderpriority IS NULL THEN 'Subtotal ' || o_orderstatus ELSE o_orderstatus || ' ' || o_orderpriority END AS label, count(*) AS n "
    "FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority))"
)
def total_row_flag(spark, d):
    r = table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    label = (
        F.when(F.col("o_orderstatus").isNull(), "Total")
        .when(F.col("o_orderpriority").isNull(), F.concat(F.lit("Subtotal "), "o_orderstatus"))
        .otherwise(F.concat_ws(" ", "o_orderstatus", "o_orderpriority"))
    )
    return r.select(label.alias("label"), "n", T.is_total_label(label).alias("is_total"))


# -- text ----------------------------------------------------------------------------------------
@_query(f"SELECT doc_id, CAST(len({duck_tokens('text')}) AS INT) AS n_tokens, CAST(len(list_distinct({duck_tokens('text')})) AS INT) AS n_terms FROM documents")
def token_counts(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"))


@_query("SELECT doc_id, CAST(greatest(1, ceil(length(text) / 3.2)) AS INT) AS tokens FROM documents")
def estimate_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens("text").alias("tokens"))


def _words(pattern: str) -> str:
    """A pattern between \\b marks, for a matcher without Unicode word boundaries."""
    return r"(?i)(^|[^\p{L}\p{N}_])(" + pattern + r")([^\p{L}\p{N}_]|$)"


_REFER = "it|its|they|them|their|those|these|that|this|he|she|his|her|same|above|previous|earlier|former|latter|last one|the other"
_OPEN = "and|also|what about|how about|why|so|then|now|ok(ay)?|compare|same"


@_query(
    rf"SELECT conv_id, turn, role, turn > 0 AND (regexp_matches(text, '{_words(_REFER)}') OR regexp_matches(text, '(?i)^({_OPEN})([^\p{{L}}\p{{N}}_]|$)') "
    r"OR len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) <= 5) AS followup FROM conversations"
)
def followup_flag(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", T.is_followup("text", F.col("turn")).alias("followup"))


def _duck(pattern: str) -> str:
    return pattern.replace("'", "''")


@_query(
    f"SELECT conv_id, turn, role, CASE WHEN regexp_matches(text, '{_duck(T.CHITCHAT)}') THEN 'chitchat' WHEN regexp_matches(text, '{_duck(T.SUMMARY)}') THEN 'summary' "
    f"WHEN regexp_matches(text, '{_duck(T.COMPARE)}') THEN 'compare' WHEN regexp_matches(text, '{_duck(T.AGGREGATE)}') THEN 'table' "
    f"WHEN regexp_matches(text, '{_duck(T.CODE)}') THEN 'code' WHEN regexp_matches(text, '{_duck(T.VISION)}') THEN 'vision' ELSE 'lookup' END AS intent, "
    r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) > 14 AND (len(regexp_extract_all(text, '\?')) > 1 OR "
    f"regexp_matches(text, '{_duck(T.CONNECTOR)}')) AS multi_part FROM conversations"
)
def intent_flags(spark, d):
    c = table(spark, d, "conversations")
    made = T.intent("text", F.col("text").rlike(T.AGGREGATE), F.col("text").rlike(T.CODE), F.col("text").rlike(T.VISION))
    return c.select("conv_id", "turn", "role", made.alias("intent"), T.is_multi_part("text").alias("multi_part"))


@_query()
def numbers_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.numbers("text")), " ").alias("numbers"))


@_query(
    "SELECT doc_id, block, CAST(count(*) AS BIGINT) AS n_lines, min(pos) AS first_line FROM (SELECT doc_id, pos, blank, "
    "sum(CASE WHEN NOT blank AND coalesce(before, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM ("
    "SELECT *, lag(blank) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM (SELECT doc_id, pos - 1 AS pos, trim(l[pos], ' ') = '' AS blank FROM ("
    "SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)))) "
    "WHERE NOT blank GROUP BY doc_id, block"
)
def line_blocks(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    b = tables.block_ids(rows, "doc_id", "at", F.trim("line") == "")
    return b.groupBy("doc_id", "block").agg(F.count("*").alias("n_lines"), F.min("at").cast("long").alias("first_line"))


_NO = "not|never|no|none|neither|nor|without|cannot|nobody|nothing"
_WORDS = r"len(list_filter(regexp_split_to_array({0}, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))"
_BARE = r"trim(regexp_replace(regexp_replace(claim, '\[\s*(S?\p{N}+(?:\s*[,;]\s*S?\p{N}+)*)\s*\]', '', 'g'), '\s+([.,;:!?])', '\1', 'g'), ' ')"
_UNITS = (
    r"CASE WHEN line LIKE '|%' THEN [line] ELSE list_filter(list_transform(string_split(regexp_replace("
    r"regexp_replace(line, '^\s*(?:[-*•]|[0-9]+[.)])\s+', ''), '([.!?\]])\s+([A-Z0-9(*\x22\x27])', '\1' || chr(1) || '\2', 'g'), chr(1)), "
    r"lambda c: trim(c, ' ')), lambda c: c <> '') END"
)


@_query(
    "WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), "
    r"lambda x: x <> '' AND NOT regexp_matches(x, '^\s*\|?\s*:?-{2,}')) AS lines FROM documents), "
    f"u AS (SELECT doc_id, flatten(list_transform(lines, lambda line: {_UNITS})) AS c FROM l), "
    "s AS (SELECT doc_id, CAST(unnest(range(len(c))) AS INT) AS place, unnest(c) AS claim FROM u), b AS (SELECT *, " + _BARE + " AS bare FROM s) "
    "SELECT doc_id, place, claim, (" + _WORDS.format("bare") + r" >= 4 OR regexp_matches(bare, '(^|[^\p{L}\p{N}\p{M}_.])[-+]?[$€£¥₹]?\p{Nd}')) "
    f"AND NOT suffix(bare, ':') AS factual, regexp_matches(claim, '{_words(_NO)}') "
    r"OR regexp_matches(claim, '(?i)n\x27t([^\p{L}\p{N}\p{M}_]|$)') AS negated FROM b"
)
def sentence_split(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.split_claims("text")).alias("place", "claim"))
    return rows.select("doc_id", "place", "claim", T.is_factual("claim").alias("factual"), T.negated("claim").alias("negated"))


def _elements(spark, d):
    """Documents as elements: one a line, the first a heading."""
    rows = table(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    kind = F.when(F.col("seq") == 0, "heading").otherwise("paragraph")
    return rows.filter(F.trim("text") != "").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("file_name"), F.col("seq").cast("long").alias("seq"),
        kind.alias("kind"), "text", F.lit(1).alias("heading_level"), F.lit(None).cast("int").alias("page"),
        (F.col("seq") + 1).alias("line_start"), (F.col("seq") + 1).alias("line_end"),
    )


@_query(
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(pos - 1 AS BIGINT) AS seq, CASE WHEN trim(l[1], ' ') <> '' THEN left(trim(l[1], ' '), 120) ELSE '' END AS section FROM ("
    "SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents) WHERE trim(l[pos], ' ') <> ''"
)
def heading_sections(spark, d):
    return chunking.sections(_elements(spark, d)).select("doc_id", "seq", F.array_join("section_path", " > ").alias("section"))


@_query()
def chunk_pack(spark, d):
    ship(spark)
    made = chunking.chunks(chunking.sections(_elements(spark, d)))
    return made.select("doc_id", "ordinal", "kind", "token_count", "line_start", "line_end", F.sha2("text", 256).alias("text_hash"))


# -- search --------------------------------------------------------------------------------------
@_query("WITH " + _POSTINGS + "SELECT term, df FROM df")
def bm25_df(spark, d):
    asked = index.query_terms(table(spark, d, "benchmark"), "item_id", "text").select("term").distinct()
    return index.document_frequency(_postings(spark, d, asked))


@_query(
    "WITH " + _POSTINGS + ", n AS (SELECT count(*) AS n FROM documents), s AS (SELECT qid, id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5))), 9) AS score "
    "FROM post JOIN q USING (term) JOIN df USING (term), n GROUP BY qid, id) "
    "SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10"
)
def bm25_topk(spark, d):
    asked = index.query_terms(table(spark, d, "benchmark"), "item_id", "text")
    n = table(spark, d, "documents").count()
    return _rounded(index.sparse_topk(_postings(spark, d, asked), asked, n, 10))


@_query()
def hash_embed(spark, d):
    e = index.hash_embedding(table(spark, d, "documents"), "doc_id", "text")
    return e.select("id", F.size("embedding").alias("dims"), F.round(index.dot("embedding", "embedding"), 6).alias("norm"))


def _dense(spark, d, keep=None):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    asked = v.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("q"))
    return index.dense_topk(v.filter(keep) if keep is not None else v, asked, 10)


_COS = (
    "SELECT q.vec_id AS qid, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score "
    "FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0"
)
_TOP = "SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ({})) WHERE rank <= 10"


def _rounded(hits):
    return hits.select("qid", "id", F.round("score", 6).alias("score"), "rank")


@_query(_TOP.format(_COS))
def cosine_topk(spark, d):
    return _rounded(_dense(spark, d))


@_query(_TOP.format(_COS + " AND v.label IN (0, 1, 2)"))
def cosine_topk_filtered(spark, d):
    return _rounded(_dense(spark, d, F.col("label").isin(0, 1, 2)))


_TWO = (
    "d AS (SELECT * FROM (" + _TOP.format(_COS) + ")), s AS (SELECT * FROM (" + _TOP.format(_COS + " AND v.label IN (0, 1, 2)") + "))"
)


@_query(
    "WITH " + _TWO + ", f AS (SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.id, s.id) AS id, d.rank AS dense_rank, s.rank AS sparse_rank, "
    "coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + s.rank), 0) AS score FROM d FULL JOIN s ON d.qid = s.qid AND d.id = s.id) "
    "SELECT qid, id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, dense_rank NULLS LAST, "
    "sparse_rank NULLS LAST, id) AS rank FROM f) WHERE rank <= 12"
)
def rrf_fusion(spark, d):
    hits = index.fuse(_dense(spark, d), _dense(spark, d, F.col("label").isin(0, 1, 2)), 12)
    return hits.select("qid", "id", F.round("score", 9).alias("score"), "rank")


@_query(
    "WITH t AS (" + _TOP.format(_COS) + "), l AS (SELECT t.*, label FROM t JOIN embeddings ON id = vec_id), "
    "c AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY rank) AS in_doc FROM l) "
    "SELECT qid, id, label, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM c WHERE in_doc <= 2) WHERE place <= 6"
)
def per_doc_cap(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    hits = index.diversify(_dense(spark, d).join(labels, "id"), per_document=2, top=6, doc_col="label")
    return hits.select("qid", "id", "label", "place")


@_query(
    "SELECT conv_id, turn, role, CASE WHEN ceil(length(text) / 3.2) < 60 AND nrole = role AND nturn = turn + 1 THEN text || chr(10) || chr(10) || ntext ELSE text END AS expanded "
    "FROM (SELECT *, lead(role) OVER w AS nrole, lead(turn) OVER w AS nturn, lead(text) OVER w AS ntext FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"
)
def neighbour_expand(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.col("role").alias("kind"), F.lit(None).cast("string").alias("section"))
    made = index.expand_short(c, doc_col="conv_id", order_col="turn")
    return made.select("conv_id", "turn", "role", "expanded")


_BENCH = f"b AS (SELECT item_id AS qid, list_distinct({duck_tokens('text')}) AS t FROM benchmark)"


@_query(
    f"WITH {_BENCH}, q AS (SELECT qid, len(t) AS n, unnest(t) AS term FROM b), p AS (SELECT doc_id, unnest(list_distinct({duck_tokens('text')})) AS term FROM documents) "
    "SELECT qid, doc_id, round(count(*) / any_value(n), 6) AS coverage FROM q JOIN p USING (term) GROUP BY qid, doc_id HAVING count(*) / any_value(n) >= 0.5"
)
def term_coverage(spark, d):
    """Documents that hold at least half of a benchmark item's terms."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.col("text").alias("card"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    m = index.match_tables(asked, docs, 0.5)
    return m.select("qid", F.col("name").alias("doc_id"), F.round("share", 6).alias("coverage"))


# -- evidence ------------------------------------------------------------------------------------
def _hits_with_text(spark, d, k=10):
    hits = index.sparse_topk(
        _postings(spark, d), index.query_terms(table(spark, d, "benchmark"), "item_id", "text"), table(spark, d, "documents").count(), k
    )
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    return hits.join(docs, "id").select(
        "qid", F.col("id").cast("string").alias("id"), F.lit("retrieval").alias("agent"), F.col("text").alias("content"), "score",
        F.col("source").alias("doc_id"), "rank",
    )


@_query(
    "SELECT vec_id AS id, CASE WHEN a >= b THEN a ELSE b END AS score, CASE WHEN a >= b THEN 'first' ELSE 'second' END AS branch "
    "FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings)"
)
def evidence_merge(spark, d):
    e = table(spark, d, "embeddings")
    one = e.select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("score"), F.lit("first").alias("branch"))
    two = e.select(F.col("vec_id").alias("id"), F.col("embedding")[1].cast("double").alias("score"), F.lit("second").alias("branch"))
    return evidence.merge([one, two])


@_query()
def evidence_select(spark, d):
    ship(spark)
    return evidence.select(_hits_with_text(spark, d)).select("qid", "s", "id", "doc_id", "score")


@_query()
def near_duplicate_ratio(spark, d):
    """Each benchmark item against the document that matches it best."""
    best = _hits_with_text(spark, d, 1)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    j = best.join(asked, "qid")
    a, b = F.substring("question", 1, 400), F.substring("content", 1, 400)
    ship(spark)
    return j.select("qid", "id", S.ratio_udf()(a, b).alias("ratio"), S.token_set_ratio_udf()("question", "content").alias("token_set"))


@_query()
def claim_verify(spark, d):
    """Benchmark items as cited answers, checked against their selected documents."""
    ship(spark)
    sources = evidence.select(_hits_with_text(spark, d, 3)).select("qid", "s", "content")
    answers = table(spark, d, "benchmark").select(
        F.col("item_id").alias("qid"), F.concat(F.regexp_replace("text", r"\n", " "), F.lit(" [S1]")).alias("answer")
    )
    v = evidence.verify(answers, sources)
    return v.select("qid", "place", "label", F.array_join(F.transform("citations", lambda x: x.cast("string")), ",").alias("citations"), "reason")


@_query()
def citation_renumber(spark, d):
    ship(spark)
    marks = F.concat(F.lit(" [S"), (F.col("item_id") % 5 + 1).cast("string"), F.lit("] again [S2, S"), (F.col("item_id") % 3 + 1).cast("string"), F.lit("] and [S9]."))
    rows = table(spark, d, "benchmark").select("item_id", F.concat("text", marks).alias("answer"), F.lit(5).alias("n_sources"))
    made = evidence.renumber(rows)
    return made.select("item_id", "final", F.array_join(F.transform("order", lambda x: x.cast("string")), ",").alias("cited"))


@_query(
    "WITH v AS (SELECT source, CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END AS p, toxic FROM documents JOIN labels USING (doc_id)), "
    "g AS (SELECT source, avg(p) AS verified, avg(CAST(toxic = 0 AS DOUBLE)) AS coverage FROM v GROUP BY source) "
    "SELECT source, round(0.45 * verified + 0.2 * 0.5 + 0.2 * coverage + 0.15, 3) AS score, "
    "CASE WHEN round(0.45 * verified + 0.2 * 0.5 + 0.2 * coverage + 0.15, 3) >= 0.75 THEN 'high' WHEN round(0.45 * verified + 0.2 * 0.5 + 0.2 * coverage + 0.15, 3) >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM g"
)
def confidence_score(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    verdicts = j.select(
        F.col("source").alias("qid"), F.lit("a plain claim here").alias("claim"),
        F.when(F.col("toxic") == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("citations"),
        F.when(F.col("quality") == 1, "supported").otherwise("uncited").alias("label"), F.lit("").alias("reason"),
    )
    cited = j.select(F.col("source").alias("qid"), F.lit("retrieval").alias("agent"), F.lit(0.5).alias("score")).distinct()
    return evidence.confidence(verdicts, cited).select(F.col("qid").alias("source"), "score", "band")


# -- evaluation ----------------------------------------------------------------------------------
@_query(
    "WITH t AS (" + _TOP.format(_COS) + "), q AS (SELECT vec_id AS qid, label AS want FROM embeddings WHERE vec_id % 50 = 0), "
    "f AS (SELECT q.qid, min(CASE WHEN label = want AND rank > 1 THEN rank END) AS r FROM q JOIN t USING (qid) JOIN embeddings ON id = vec_id GROUP BY q.qid) "
    "SELECT round(avg(CASE WHEN r IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM f"
)
def hit_at_k_mrr(spark, d):
    e = table(spark, d, "embeddings")
    labels = e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("file"))
    page = F.lit(None).cast("int")
    hits = _dense(spark, d).filter("rank > 1").join(labels, "id").select(
        F.lit("dense").alias("mode"), "qid", "rank", "file", page.alias("page_start"), page.alias("page_end"), F.lit(False).alias("page_approx")
    )
    expected = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("label").cast("string").alias("file"), page.alias("page"))
    s = evaluation.retrieval_scores(evaluation.ranks(hits, expected, 10))
    return s.select(F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"))


@_query(
    "SELECT round(sum(n * abs(conf - acc)) / sum(n), 3) AS ece FROM (SELECT least(floor(c * 5), 4) AS b, count(*) AS n, avg(c) AS conf, avg(ok) AS acc FROM ("
    "SELECT (doc_id % 100) / 100.0::DOUBLE AS c, CAST(quality AS DOUBLE) AS ok FROM labels) GROUP BY b)"
)
def ece_bins(spark, d):
    rows = table(spark, d, "labels").select(((F.col("doc_id") % 100) / F.lit(100.0)).alias("confidence"), (F.col("quality") == 1).alias("correct"))
    return evaluation.calibration_error(rows)


@_query(
    "WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) "
    "SELECT event_type, round(median(value), 6) AS p50, round(max(CASE WHEN i = floor(0.95 * (n - 1)) THEN value END), 6) AS p95 FROM s GROUP BY event_type"
)
def latency_p95(spark, d):
    m = evaluation.latency(table(spark, d, "events"), ["event_type"], "value")
    return m.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@_query("SELECT lang, round(avg(CAST(quality AS DOUBLE)), 2) AS accuracy, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def accuracy_by_type(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("correct", F.col("quality") == 1)
    return evaluation.accuracy_by(j, "lang")


@_query(
    "SELECT avg(CASE WHEN quality = 0 THEN CAST(toxic AS DOUBLE) END) AS abstain_recall, avg(CASE WHEN toxic = 1 THEN CAST(quality = 0 AS DOUBLE) END) AS abstain_precision FROM labels"
)
def abstain_metrics(spark, d):
    rows = table(spark, d, "labels").select((F.col("quality") == 1).alias("answerable"), (F.col("toxic") == 1).alias("abstained"))
    return evaluation.abstention(rows)


# -- routing -------------------------------------------------------------------------------------
@_query()
def route_questions(spark, d):
    """User turns routed with a probe over the part catalog."""
    asked = table(spark, d, "conversations").filter("role = 'user'").select(
        F.xxhash64("conv_id", "turn").alias("qid"), F.col("text").alias("question")
    )
    cards = table(spark, d, "nation").select(F.lower("n_name").alias("name"), F.col("n_name").alias("card"))
    probe = asked.select(
        "qid", F.lit(1).alias("rank"), F.lit(1).alias("sparse_rank"), F.lit("paragraph").alias("kind"),
        F.lit(None).cast("string").alias("table_name"), F.lit("d").alias("doc_id"),
    )
    none = asked.select("qid", F.lit("d").alias("doc_id")).filter(F.lit(False))
    symbols = cards.select("name").filter(F.lit(False))
    plans = router.route(asked, probe, cards, symbols, none)
    return plans.select("qid", F.size("tables").alias("n_tables"), "use_vision", "use_code", "intent", "multi_part")


# -- extensions ----------------------------------------------------------------------------------
@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@_query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS html_chars FROM pages")
def html_title_text(spark, d):
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length("html").cast("long").alias("html_chars")
    )


@_query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_count(spark, d):
    return ev.tumbling(table(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 4))


@_query(
    "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes' * k AS start FROM events, "
    "(SELECT unnest([0, 1]) AS k)) GROUP BY 1, 2"
)
def sliding_count(spark, d):
    return ev.sliding(table(spark, d, "events"), "1 hour", "30 minutes")


@_query(
    "SELECT user_id, session, min(ts) AS start, max(ts) AS \"end\", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM ("
    "SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 1800 SECOND OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) "
    "GROUP BY user_id, session"
)
def session_gap(spark, d):
    return ev.sessions(table(spark, d, "events"), 1800)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
