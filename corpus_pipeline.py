"""The corpus pipeline over ``documents``: quality rules, near-dedup, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet to the
shared folder and rereads it as the next stage's docs. All stages but the last return the columns of
documents. Nulls, ties and repeated rows have the results that the operators define; near-dedup
leaves one row of each group, also where ids repeat or are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import neardup, packing, privacy, quality, repeats
from tesserae.llm.queries import tokenizer_file
from tesserae.runtime import discard, settle, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; lines found across their host go from the others."""
    return _recounted(quality.keep(docs.select(*COLUMNS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a Jaccard similarity of 0.8 or more one row stays, that with the smallest id."""
    return neardup.one_of_each(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that stand elsewhere too are cut."""
    return _recounted(repeats.remove_repeats(docs.select(*COLUMNS)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are generalised."""
    return _recounted(privacy.sanitise(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024, one row per piece."""
    return packing.digest(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("repeats", repeated_passages),
    ("privacy", personal_data),
    ("packing", pack),
]

#: Fingerprints, byte spans and tokens have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        before, held = held, []
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}", held)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
