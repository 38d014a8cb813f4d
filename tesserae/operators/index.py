"""Search: BM25 postings, hashed and dense vectors, top-k, rank fusion, per-document cap, neighbours.

A batch of queries is a DataFrame; nothing loops over queries. Postings are a long table, so a
sparse search is an equi-join on the term with the query side small, and top-k is a window with a
rank limit, which Spark prunes before the shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.runtime import settle, ship

K1, B, AVERAGE_LENGTH, RRF_K = 1.2, 0.75, 256.0, 60
DIMENSIONS = 384


def token_table(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, tokens)``; a column of token arrays is taken as it is, so that a settled token table serves every index."""
    ready = dict(chunks.dtypes)[text_col] == "array<string>"
    return chunks.select(F.col(id_col).alias("id"), (F.col(text_col) if ready else T.tokens(text_col)).alias("tokens"))


def postings(chunks: DataFrame, id_col: str, text_col: str, terms: DataFrame | None = None) -> DataFrame:
    """``(id, term, tf, length, weight)``: BM25 document weights with a fixed average length.

    With ``terms`` only tokens among its column ``term`` are counted at all. Texts are tokenised into a
    settled table first: the plan below names the tokens twice, and would else make them twice."""
    rows = token_table(chunks, id_col, text_col)
    if dict(chunks.dtypes)[text_col] != "array<string>":
        rows = settle(rows, "search-tokens")
    counted = rows.select("id", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    if terms is not None:
        counted = counted.join(terms.select("term").distinct(), "term", "left_semi")
    tf = counted.groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
    norm = K1 * (1 - B + B * F.col("length") / AVERAGE_LENGTH)
    return tf.withColumn("weight", F.col("tf") * (K1 + 1) / (F.col("tf") + norm))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(qid, term)``: distinct query tokens, each of weight one."""
    return queries.select(
        F.col(id_col).alias("qid"), F.explode(F.array_distinct(T.tokens(text_col))).alias("term")
    )


def _top(scored: DataFrame, k: int, by: str = "qid") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), F.col("id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def sparse_topk(posted: DataFrame, terms: DataFrame, n_docs: int | Column, k: int) -> DataFrame:
    """``(qid, id, score, rank)``: dot product of query terms and weights times IDF, to nine digits, best k a query.

    Only postings of query terms take part; they are settled, since both the frequencies and the
    scores read them: the vocabulary is never aggregated as a whole and no text is tokenised twice."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    wanted = settle(posted.join(terms.select("term").distinct(), "term", "left_semi"), "search-postings")
    weighted = wanted.join(document_frequency(wanted), "term").select(
        "id", "term", (F.col("weight") * idf(F.col("df"), n)).alias("w")
    )
    scored = weighted.join(terms, "term").groupBy("qid", "id").agg(F.round(F.sum("w"), 9).alias("score"))
    return _top(scored, k)


def hash_embedding(chunks: DataFrame, id_col: str, text_col: str, dims: int = DIMENSIONS) -> DataFrame:
    """``(id, embedding)`` per row: signed hashed bag of words, unit length; without tokens the first axis."""
    ship(chunks.sparkSession)
    rows = token_table(chunks, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tokens = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 2000):
                part = tokens.slice(at, 2000)
                coded = part.flatten().dictionary_encode()
                h = np.array([zlib.crc32(t.encode()) for t in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
                owner = np.repeat(np.arange(len(part)), pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False))
                sign = np.where(h >> 20 & 1, 1.0, -1.0)
                table = np.bincount(owner * dims + h % dims, sign, minlength=len(part) * dims).astype(np.float64).reshape(len(part), dims)
                norm = np.sqrt((table * table).sum(axis=1))
                table[norm == 0] = np.eye(1, dims)
                table /= np.where(norm == 0, 1, norm)[:, None]
                ends = pa.array(np.arange(0, len(part) * dims + 1, dims), pa.int32())
                yield pa.RecordBatch.from_arrays([ids.slice(at, 2000), pa.ListArray.from_arrays(ends, pa.array(table.ravel()))], ["id", "embedding"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, embedding array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(T.col(a), T.col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def restrict(rows: DataFrame, doc_ids: list | None = None, kinds: list | None = None, doc_col="doc_id", kind_col="kind"):
    """Filters of a search: no list of documents means all, an empty one means none; kinds if any."""
    if doc_ids is not None:
        rows = rows.filter(F.col(doc_col).isin(doc_ids)) if doc_ids else rows.filter(F.lit(False))
    return rows.filter(F.col(kind_col).isin(kinds)) if kinds else rows


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, block_bytes: int = 64 << 20) -> DataFrame:
    """``(qid, id, score, rank)``: the k vectors nearest to each query by cosine, to nine digits.

    A stated query set against all rows, in blocks: queries (qid, q) travel to the tasks in blocks of
    at most ``block_bytes``; each Arrow batch is one matrix product, of which only the best k a query
    leave the task. Vectors that are null, zero or of another length take no part."""
    ship(vectors.sparkSession)
    rows = queries.filter("q IS NOT NULL").select("qid", F.col("q").cast("array<double>").alias("q")).toArrow()
    ids, wanted = rows.column(0).to_pylist(), rows.column(1).to_pylist()
    dims = len(wanted[0]) if wanted else 0
    step = max(1, block_bytes // (8 * max(dims, 1)))
    found = None
    for at in range(0, max(len(ids), 1), step):
        part = _block_topk(vectors, ids[at : at + step], np.array(wanted[at : at + step], np.float64).reshape(-1, dims), k)
        found = part if found is None else found.unionByName(part)
    kinds = dict(queries.dtypes)["qid"], dict(vectors.dtypes)["id"]
    typed = found.select(F.col("qid").cast(kinds[0]).alias("qid"), F.col("id").cast(kinds[1]).alias("id"), "score")
    return _top(typed, k)


def _block_topk(vectors: DataFrame, ids: list, wanted: np.ndarray, k: int) -> DataFrame:
    norms = np.linalg.norm(wanted, axis=1, keepdims=True)
    unit = np.divide(wanted, norms, out=np.zeros_like(wanted), where=norms > 0)
    live, dims = norms[:, 0] > 0, wanted.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
            size = np.linalg.norm(v, axis=1)
            good = np.flatnonzero(np.isfinite(size) & (size > 0))
            keys = batch.column(0).to_numpy(zero_copy_only=False)[good]
            score = np.round(unit @ (v[good] / size[good, None]).T, 9)
            out: tuple[list, list, list] = ([], [], [])
            for q in np.flatnonzero(live):
                near = np.arange(len(good))
                if len(near) > k:
                    edge = np.partition(score[q], len(near) - k)[len(near) - k]
                    near = np.flatnonzero(score[q] >= edge)
                best = near[np.lexsort((keys[near], -score[q][near]))][:k]
                out[0].extend([str(ids[q])] * len(best))
                out[1].extend(map(str, keys[best].tolist()))
                out[2].extend(score[q][best].tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], ["qid", "id", "score"]
            )

    fit = vectors.filter(F.size("embedding") == dims) if dims else vectors.filter(F.lit(False))
    filled = fit.filter(~F.exists("embedding", lambda x: x.isNull()))
    return filled.select("id", F.col("embedding").cast("array<double>")).mapInArrow(run, "qid string, id string, score double")


def fuse(dense: DataFrame, sparse: DataFrame, limit: int) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists; ties keep the dense order, then the sparse one."""
    d = dense.select("qid", "id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    s = sparse.select("qid", "id", F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_score"))
    part = lambda r: F.coalesce(1 / (F.lit(RRF_K) + F.col(r)), F.lit(0.0))
    both = d.join(s, ["qid", "id"], "full").withColumn("score", part("dense_rank") + part("sparse_rank"))
    order = Window.partitionBy("qid").orderBy(
        F.col("score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last(), "id"
    )
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def search(dense: DataFrame | None, sparse: DataFrame | None, mode: str, limit: int) -> DataFrame:
    """Mode hybrid, dense or sparse; a single list is fused with nothing, so scores are comparable."""
    if mode not in ("hybrid", "dense", "sparse"):
        raise ValueError(f"unknown search mode {mode}")
    given = dense if dense is not None else sparse
    none = given.filter(F.lit(False))
    return fuse(dense if mode != "sparse" else none, sparse if mode != "dense" else none, limit)


def relevance(rerank: str = "rerank", dense_score: str = "dense_score") -> Column:
    return F.coalesce(F.col(rerank), F.greatest(F.lit(0.0), F.coalesce(F.col(dense_score), F.lit(0.0))))


def diversify(hits: DataFrame, per_document: int = 3, top: int = 6, doc_col: str = "doc_id", query_col: str = "qid") -> DataFrame:
    """At most ``per_document`` hits of a document in rank order, then the best ``top`` of a query."""
    in_doc = Window.partitionBy(query_col, doc_col).orderBy("rank")
    kept = hits.withColumn("in_doc", F.row_number().over(in_doc)).filter(F.col("in_doc") <= per_document)
    place = Window.partitionBy(query_col).orderBy("rank")
    return kept.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= top)


def expand_short(
    chunks: DataFrame, least_tokens: int = 60, doc_col: str = "doc_id", order_col: str = "ordinal", text_col: str = "text"
) -> DataFrame:
    """Short prose chunks get the text of the next chunk of the same section and kind."""
    w = Window.partitionBy(doc_col).orderBy(order_col)
    ahead = lambda c: F.lead(c).over(w)
    fits = (
        (T.estimate_tokens(text_col) < least_tokens)
        & ~F.col("kind").isin("table", "table_card", "code")
        & (ahead("kind") == F.col("kind"))
        & ahead("section").eqNullSafe(F.col("section"))
        & (ahead(order_col) == F.col(order_col) + 1)
    )
    joined = F.concat(F.col(text_col), F.lit("\n\n"), ahead(text_col))
    return chunks.select("*", F.when(fits, joined).otherwise(F.col(text_col)).alias("expanded"))


def interval_join(left: DataFrame, right: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], width: int = 128) -> DataFrame:
    """Rows of equal ``key`` whose closed intervals overlap: binned by ``width``, so that a key with
    many intervals is no nested loop; each pair is found in the first bin that the two share."""
    bins = lambda lo, hi: F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))
    x = left.withColumn("bin", F.explode(bins(*a)))
    y = right.withColumn("bin", F.explode(bins(*b)))
    first = F.greatest(F.floor(F.col(a[0]) / width), F.floor(F.col(b[0]) / width))
    return (
        x.join(y, [key, "bin"])
        .filter((F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1])) & (F.col("bin") == first))
        .drop("bin")
    )


def match_tables(questions: DataFrame, tables: DataFrame, least: float = 0.15) -> DataFrame:
    """``(qid, name, share)``: the tables whose card shares ``least`` of the question's tokens.
    Meets on tokens, not by pairing every question with every table."""
    q = questions.select("qid", F.array_distinct(T.tokens("question")).alias("qt")).select(
        "qid", F.size("qt").alias("n"), F.explode("qt").alias("token")
    )
    t = tables.select("name", F.explode(F.array_distinct(T.tokens("card"))).alias("token"))
    shared = q.join(t, "token").groupBy("qid", "name", "n").agg((F.count("*") / F.first("n")).alias("share"))
    return shared.filter(F.col("share") >= least).select("qid", "name", "share")
