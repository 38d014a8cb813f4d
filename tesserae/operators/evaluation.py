"""Retrieval and answer metrics as aggregates over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_matches(page: Column, start: Column, end: Column, approximate: Column) -> Column:
    """A missing page matches; approximate pages may be one off."""
    slack = F.when(approximate, 1).otherwise(0)
    return page.isNull() | page.between(start - slack, end + slack)


def ranks(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """``(mode, qid, rank)``: first matching rank in the top k, null if there is none. ``hits`` is
    (mode, qid, rank, file, page_start, page_end, page_approx), ``expected`` (qid, file, page)."""
    near = hits.filter(F.col("rank") <= k)
    ok = near.join(expected.withColumnRenamed("page", "want"), ["qid", "file"]).filter(
        page_matches(F.col("want"), F.col("page_start"), F.col("page_end"), F.col("page_approx"))
    )
    first = ok.groupBy("mode", "qid").agg(F.min("rank").alias("rank"))
    return hits.select("mode", "qid").distinct().join(expected.select("qid").distinct(), "qid").join(first, ["mode", "qid"], "left")


def retrieval_scores(ranked: DataFrame) -> DataFrame:
    """hit rate and mean reciprocal rank of each mode."""
    return ranked.groupBy("mode").agg(
        F.avg(F.col("rank").isNotNull().cast("double")).alias("hit_rate"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr")
    )


def answer_correct(answer: Column, answer_numbers: Column, numbers: Column, keywords: Column, answerable: Column, abstained: Column) -> Column:
    """All expected numbers and keywords are there; an unanswerable question is abstained from."""
    there = F.forall(numbers, lambda n: F.array_contains(answer_numbers, n)) & F.forall(
        keywords, lambda w: F.contains(F.lower(answer), F.lower(w))
    )
    return F.when(~answerable, abstained).otherwise(~abstained & there)


def share(part: Column, whole: Column) -> Column:
    """|part and whole| / |whole|; null for an empty whole."""
    return F.try_divide(F.size(F.array_intersect(part, whole)), F.nullif(F.size(F.array_distinct(whole)), F.lit(0)))


def calibration_error(results: DataFrame, confidence: str = "confidence", correct: str = "correct", bins: int = 5) -> DataFrame:
    """One row ``ece``: equal bins, the last includes 1."""
    at = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    per = results.groupBy(at.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(confidence).alias("conf"), F.avg(F.col(correct).cast("double")).alias("acc")
    )
    return per.agg(F.round(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n"), 3).alias("ece"))


def abstention(results: DataFrame) -> DataFrame:
    """Recall over unanswerable questions, precision over abstentions."""
    as_number = F.col("abstained").cast("double")
    return results.agg(
        F.avg(F.when(~F.col("answerable"), as_number)).alias("abstain_recall"),
        F.avg(F.when(F.col("abstained"), (~F.col("answerable")).cast("double"))).alias("abstain_precision"),
    )


def latency(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, and p95 as the element at int(0.95 * (n - 1)) of the sorted values; nulls take no part.

    Ranks are counted: equal values combine before the shuffle, and running counts over the distinct
    values tell where an element falls."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.select(*keys, value, F.sum("c").over(upto).alias("upto"), F.sum("c").over(whole).alias("n"))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col(value)))
    last = F.col("n") - 1
    return placed.groupBy(*keys).agg(
        ((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2).alias("p50"), at(F.floor(F.lit(0.95) * last)).alias("p95")
    )


def accuracy_by(results: DataFrame, key: str, correct: str = "correct") -> DataFrame:
    return results.groupBy(key).agg(F.round(F.avg(F.col(correct).cast("double")), 2).alias("accuracy"), F.count("*").alias("n"))
