"""Delimited text files as typed tables with row provenance."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.tables import frame_to_table, unique_names


def sniff(sample: str) -> str:
    """The delimiter among , ; tab and | that the sample's lines agree on."""
    try:
        return csv.Sniffer().sniff(sample[:20_000], delimiters=",;\t|").delimiter
    except csv.Error:
        first = sample.split("\n", 1)[0]
        return max(",;\t|", key=first.count) if first else ","


def grid(text: str) -> list[list[str | None]]:
    """The records of a delimited text, header first; an empty cell is None."""
    rows = csv.reader(text.lstrip("\ufeff").splitlines(keepends=True), delimiter=sniff(text), skipinitialspace=True)
    return [[cell or None for cell in row] for row in rows]


def read(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """All text first, then typed. ``_row`` is the place of a record in its file, counted from 2 below
    the header: the file is read in one split and numbered as it is read."""
    head = spark.read.text(path, wholetext=False).limit(50).collect()  # a sample for the delimiter
    delimiter = delimiter or sniff("\n".join(r[0] for r in head))
    names = next(csv.reader([head[0][0]], delimiter=delimiter)) if head else []
    names = unique_names([n.strip().lstrip("﻿") or f"column {i + 1}" for i, n in enumerate(names)])
    if not names:
        raise ValueError(f"{path} has no header")
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = (
        spark.read.schema(schema).option("header", True).option("sep", delimiter).option("nullValue", "")
        .option("multiLine", True).option("ignoreLeadingWhiteSpace", True).option("enforceSchema", True).csv(path)
    )
    return frame_to_table(rows.withColumn("__at", F.monotonically_increasing_id()), "__at")
