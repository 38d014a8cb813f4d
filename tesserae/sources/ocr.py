"""Recognised lines to blocks; recognisers and captioners are plug-ins that run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP = 1.2
MOST_CAPTIONS, LEAST_SIDE = 12, 96


def group_lines(lines: DataFrame, page: str = "page_id", gap: float = GAP) -> DataFrame:
    """Lines (page, text, conf, x0, y0, x1, y1) to blocks: text, box, mean confidence. A block ends
    where the gap to the next line is over ``gap`` times the height of the line above it."""
    w = Window.partitionBy(page).orderBy("y0", "x0")
    height = F.greatest(F.lag("y1").over(w) - F.lag("y0").over(w), F.lit(1.0))
    fresh = F.coalesce(F.col("y0") - F.lag("y1").over(w) > gap * height, F.lit(True))
    placed = lines.withColumn("fresh", fresh.cast("int")).withColumn("block", F.sum("fresh").over(w))
    ordered = F.array_sort(F.collect_list(F.struct("y0", "x0", "text")))
    return placed.groupBy(page, "block").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"), *union_box(), F.round(F.avg("conf"), 3).alias("conf")
    )


def union_box() -> list:
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def recognise(images: DataFrame, load: Callable[[], Callable[[bytes], list[tuple]]]) -> DataFrame:
    """``(page_id, content)`` to lines; ``load`` makes the recogniser once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = load()
        for pdf in batches:
            rows = [(p, *line) for p, c in zip(pdf["page_id"], pdf["content"], strict=True) for line in engine(bytes(c))]
            yield pd.DataFrame(rows, columns=["page_id", "text", "conf", "x0", "y0", "x1", "y1"])

    return images.select("page_id", "content").mapInPandas(
        run, "page_id string, text string, conf double, x0 double, y0 double, x1 double, y1 double"
    )


def to_caption(figures: DataFrame) -> DataFrame:
    """The figures a captioner sees: at most twelve of a document, none with a side under 96 pixels."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    big = figures.filter((F.col("width") >= LEAST_SIDE) & (F.col("height") >= LEAST_SIDE))
    return big.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= MOST_CAPTIONS).drop("n")
