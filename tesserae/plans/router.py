"""Routing: which branches a batch of questions takes, from their text and a cheap probe search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import similarity as S
from tesserae.functions import text as T
from tesserae.operators.index import match_tables


def mentioned_documents(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """``(qid, doc_id)``: documents whose file name or stem the question names. A stated query set
    against the catalog: the pairing is a nested loop with the questions on the small side."""
    stem = F.trim(F.regexp_replace(F.lower(F.regexp_replace("file_name", r"\.[^.]*$", "")), r"[_\-.]+", " "))
    pairs = documents.select("doc_id", F.lower("file_name").alias("name"), stem.alias("stem")).join(
        questions.select("qid", F.lower("question").alias("q"))
    )
    partial = S.partial_ratio_udf()
    named = F.contains("q", "name")
    alike = F.when(named, 100.0).when(F.length("stem") > 4, partial("stem", "q")).otherwise(0.0)
    return pairs.withColumn("alike", alike).filter("alike >= 90").select("qid", "doc_id")


def route(questions: DataFrame, probe: DataFrame, tables: DataFrame, symbols: DataFrame, named: DataFrame) -> DataFrame:
    """``(qid, tables, use_vision, use_code, intent, multi_part)``.

    ``probe`` holds the ranked probe hits (qid, rank, sparse_rank, kind, table_name, doc_id), ``tables``
    (name, card), ``symbols`` (name), ``named`` the documents each question names."""
    q = questions.select("qid", "question")
    per = probe.groupBy("qid").agg(
        F.array_sort(
            F.collect_list(F.when((F.col("rank") <= 5) & F.col("table_name").isNotNull(), F.struct("rank", "table_name")))
        ).alias("hit_tables"),
        F.bool_or((F.col("rank") == 1) & (F.col("kind") == "table_card") & (F.col("sparse_rank") <= 2)).alias("card_first"),
        F.bool_or((F.col("rank") <= 8) & (F.col("kind") == "figure")).alias("figure8"),
        F.bool_or((F.col("rank") <= 2) & (F.col("kind") == "figure")).alias("figure2"),
        F.bool_or((F.col("rank") <= 3) & (F.col("kind") == "code")).alias("code3"),
    )
    by_name = match_tables(q, tables).groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "name"))), lambda x: x["name"]).alias("named_tables")
    )
    words = q.select("qid", F.explode(F.array_distinct(F.split("question", r"[^\w.]+"))).alias("name"))
    known = words.filter(F.length("name") > 2).join(symbols, "name", "left_semi").select("qid").distinct().withColumn("has_symbol", F.lit(True))
    files = named.select("qid").distinct().withColumn("has_file", F.lit(True))
    every = tables.agg(F.when(F.count("*") <= 3, F.sort_array(F.collect_set("name"))).alias("all_tables"))
    j = (
        q.join(per, "qid", "left").join(by_name, "qid", "left").join(known, "qid", "left").join(files, "qid", "left")
        .join(F.broadcast(every))  # one row
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    wants_table = F.col("question").rlike(T.AGGREGATE) | yes(F.col("card_first"))
    none = F.array().cast("array<string>")
    found = F.array_distinct(
        F.concat(F.coalesce(F.transform("hit_tables", lambda x: x["table_name"]), none), F.coalesce("named_tables", none))
    )
    chosen = F.slice(F.when(F.size(found) > 0, found).otherwise(F.coalesce("all_tables", none)), 1, 3)
    use_tables = F.when(wants_table, chosen).otherwise(none)
    vision = yes(F.col("figure8")) & (F.col("question").rlike(T.VISION) | yes(F.col("figure2")))
    code = yes(F.col("has_symbol")) | (F.col("question").rlike(T.CODE) & (yes(F.col("code3")) | yes(F.col("has_file"))))
    made = j.select("qid", "question", use_tables.alias("tables"), vision.alias("use_vision"), code.alias("use_code"))
    return made.select(
        "qid",
        "tables",
        "use_vision",
        "use_code",
        T.intent("question", F.size("tables") > 0, F.col("use_code"), F.col("use_vision")).alias("intent"),
        T.is_multi_part("question").alias("multi_part"),
    )


def sub_queries(plans: DataFrame, questions: DataFrame, named: DataFrame, probe: DataFrame, most: int = 4) -> DataFrame:
    """``(qid, sub, question, doc_id)``: one search, or for comparisons and summaries one for each
    named document; a comparison that names none adds the three best documents of the probe."""
    base = plans.select("qid", "intent").join(questions.select("qid", "question"), "qid")
    docs = named.groupBy("qid").agg(F.slice(F.sort_array(F.collect_set("doc_id")), 1, most).alias("docs"))
    best = probe.filter("rank <= 10").groupBy("qid", "doc_id").agg(F.min("rank").alias("r"))
    top = best.groupBy("qid").agg(
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("r", "doc_id"))), lambda x: x["doc_id"]), 1, 3).alias("top")
    )
    j = base.join(docs, "qid", "left").join(top, "qid", "left")
    kind = dict(probe.dtypes)["doc_id"]
    whole = F.array(F.lit(None).cast(kind))
    scoped = (
        F.when(F.col("intent").isin("compare", "summary") & F.col("docs").isNotNull(), F.col("docs"))
        .when((F.col("intent") == "compare") & F.col("top").isNotNull(), F.concat(whole, F.col("top")))
        .otherwise(whole)
    )
    return j.select("qid", "question", F.posexplode(scoped).alias("sub", "doc_id"))
