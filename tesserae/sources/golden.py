"""Golden question sets and evaluation reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import evaluation as ev

GOLDEN = (
    "id string, question string, reference string, type string, answerable boolean, must_cite array<struct<file:string,page:int>>, "
    "expected_numbers array<string>, expected_keywords array<string>, history array<string>, requires_large boolean"
)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(GOLDEN).json(path)
    none = F.array()
    defaults = {c: F.coalesce(c, none.cast(dict(rows.dtypes)[c])) for c in ("must_cite", "expected_numbers", "expected_keywords", "history")}
    return rows.withColumns(defaults | {c: F.coalesce(c, F.lit(c == "answerable")) for c in ("answerable", "requires_large")})


def write_golden(golden: DataFrame, path: str) -> None:
    golden.write.mode("overwrite").json(path)


def expected_sources(golden: DataFrame) -> DataFrame:
    """``(qid, file, page)`` of the items that count for retrieval: answerable, with sources, no follow-ups."""
    kept = golden.filter(F.col("answerable") & (F.size("must_cite") > 0) & (F.size("history") == 0))
    return kept.select(F.col("id").alias("qid"), F.inline("must_cite"))


def judge(golden: DataFrame, answers: DataFrame) -> DataFrame:
    """One row an item: correct, citation precision and recall. ``answers`` is (qid, answer, abstained,
    confidence, cited_files, seconds)."""
    j = golden.join(answers, golden.id == answers.qid)
    files = F.array_distinct(F.transform("must_cite", lambda s: s["file"]))
    correct = ev.answer_correct(
        F.col("answer"), T.numbers("answer"), F.col("expected_numbers"), F.col("expected_keywords"), F.col("answerable"), F.col("abstained")
    )
    return j.select(
        "qid", "type", "answerable", "abstained", "confidence", "seconds", correct.alias("correct"),
        ev.share(files, F.col("cited_files")).alias("citation_precision"), ev.share(F.col("cited_files"), files).alias("citation_recall"),
    )


def report(results: DataFrame, ranked: DataFrame | None = None) -> dict:
    """The metrics of a run; a few rows reach the driver."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 3).alias(c)
    row = results.agg(F.count("*").alias("n"), mean("correct"), mean("citation_precision"), mean("citation_recall")).first().asDict()
    row |= ev.abstention(results).first().asDict()
    row |= ev.calibration_error(results).first().asDict()
    row |= ev.latency(results.withColumn("all", F.lit(1)), ["all"], "seconds").select("p50", "p95").first().asDict()
    row["by_type"] = {r.type: r.accuracy for r in ev.accuracy_by(results, "type").collect()}
    if ranked is not None:
        row["retrieval"] = {r["mode"]: {"hit_rate": r.hit_rate, "mrr": r.mrr} for r in ev.retrieval_scores(ranked).collect()}
    return row


def write_report(values: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as out:
        json.dump(values, out, indent=2, default=str)
