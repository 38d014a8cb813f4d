"""The queries over the driver's tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import bpe, forest, html, packing, privacy, quality, repeats, simhash, toxicity, warc
from tesserae.runtime import table

def tokenizer_file(name: str) -> str:
    """Where a public tokenizer file lies; never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op3_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.digest(table(spark, sf_dir, "embeddings"))


def op4_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.digest(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.digest(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_repeats": op1_repeats,
        "op2_bpe": op2_bpe,
        "op3_forest": op3_forest,
        "op4_privacy": op4_privacy,
        "op5_toxicity": op5_toxicity,
        "op6_html": op6_html,
        "op7_warc": op7_warc,
        "op8_packing": op8_packing,
        "op9_quality": op9_quality,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": warc.SQL, "op9_quality": quality.SQL}
