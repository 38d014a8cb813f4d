"""Retrieval in one operator: search, rerank, cap by document, neighbours, evidence rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import evidence, index
from tesserae.operators.catalog import with_documents

PROBE, CANDIDATES = 20, 30
_PLACES = {"file_name": "string", "file_type": "string", "sheet": "string", "page_approx": "boolean"}


def lists(chunks: DataFrame, questions: DataFrame, k: int = CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """Dense and sparse top ``k`` of (qid, question) over chunks (chunk_id, ctx_header, text)."""
    body = chunks.withColumn("__body", F.concat_ws("\n", "ctx_header", "text"))
    terms = index.query_terms(questions, "qid", "question")
    sparse = index.sparse_topk(index.postings(body, "chunk_id", "__body"), terms, chunks.count(), k)
    asked = index.hash_embedding(questions, "qid", "question").select(F.col("id").alias("qid"), F.col("embedding").alias("q"))
    return index.dense_topk(index.hash_embedding(body, "chunk_id", "__body"), asked, k), sparse


def hits(chunks: DataFrame, questions: DataFrame, mode: str = "hybrid", k: int = CANDIDATES) -> DataFrame:
    """Ranked hits with the columns of their chunk."""
    dense, sparse = lists(chunks, questions, k)
    found = index.search(dense, sparse, mode, k).drop("doc_id", "file_name")
    return found.join(chunks, F.col("id") == F.col("chunk_id").cast("string"))


def probe(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """What routing looks at: the hybrid top 20, not reranked."""
    return hits(chunks, questions, "hybrid", PROBE)


def run(
    chunks: DataFrame, questions: DataFrame, mode: str = "hybrid", rerank: Callable[[DataFrame], DataFrame] | None = None,
    per_document: int = 3, top: int = 6, documents: DataFrame | None = None,
) -> DataFrame:
    """Evidence rows of each question. ``rerank`` takes ranked hits and returns them with a new ``rank``;
    ``documents`` (doc_id, file_name) names the files of chunks that carry no name."""
    found = hits(chunks, questions, mode)
    found = rerank(found) if rerank else found
    if documents is not None and "file_name" not in found.columns:
        found = with_documents(found, documents, "left")
    for name, kind in _PLACES.items():
        if name not in found.columns:
            found = found.withColumn(name, F.lit(None).cast(kind))
    return evidence.from_hits(index.diversify(found, per_document, top))
