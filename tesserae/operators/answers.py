"""What surrounds a model's answer: source lists, replies of a vision model, rerank plug-in, drafts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import text as T

VISION_SCORE = 0.75


def format_sources(sources: DataFrame) -> DataFrame:
    """``(qid, prompt)``: each question's numbered sources with their labels."""
    block = F.concat(F.lit("[S"), F.col("s").cast("string"), F.lit("] "), F.coalesce("label", F.lit("")), F.lit("\n"), "content")
    blocks = F.array_sort(F.collect_list(F.struct("s", block.alias("b"))))
    return sources.groupBy("qid").agg(F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n").alias("prompt"))


def vision_evidence(replies: DataFrame) -> DataFrame:
    """Replies (qid, chunk_id, file_name, reply) to evidence; images that do not hold the answer drop out."""
    answer = F.regexp_extract("reply", r"(?is)ANSWER:\s*(.*)$", 1)
    seen = F.trim(F.regexp_extract("reply", r"(?is)OBSERVATION:\s*(.*?)(?=\n\s*ANSWER:|$)", 1))
    found = replies.filter((F.trim("reply") != "") & ~F.upper("reply").contains("NOT_IN_IMAGE"))
    content = F.concat(
        F.lit("Observation of the image in "), "file_name", F.lit(": "), seen, F.lit("\nAnswer read from the image: "),
        F.trim(F.when(answer != "", answer).otherwise(F.col("reply"))),
    )
    return found.select(
        "qid", F.concat(F.lit("vision:"), "chunk_id").alias("id"), F.lit("vision").alias("agent"), content.alias("content"), F.lit(VISION_SCORE).alias("score"), "file_name"
    )


def rerank(hits: DataFrame, load: Callable[[], Callable[[list[str], list[str]], list[float]]], question: str = "question", text: str = "text") -> DataFrame:
    """Hits with ``rerank``, a plug-in's score squashed to 0..1; ``load`` makes the model once a task."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in batches:
            yield pd.Series(model(list(q), list(t)), dtype="float64")

    made = F.pandas_udf(run, "double")
    return hits.withColumn("rerank", T.sigmoid(made(F.col(question), F.col(text))))


def embed_text(header: str = "ctx_header", text: str = "text") -> Column:
    return F.concat(F.coalesce(header, F.lit("")), F.lit("\n"), F.col(text))


def outcome(answers: DataFrame) -> DataFrame:
    """``status`` of each question: no_documents, low_relevance, not_found, unverified or answered.
    ``answers`` is (qid, n_documents, reason, draft, n_supported, n_factual)."""
    status = (
        F.when(F.col("n_documents") == 0, "no_documents")
        .when(F.col("reason").isNotNull(), F.col("reason"))
        .when(T.is_not_found("draft"), "not_found")
        .when((F.col("n_factual") > 0) & (F.col("n_supported") == 0), "unverified")
        .otherwise("answered")
    )
    return answers.withColumn("status", status)
