"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.runtime import checkpoint_dir


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select("v", "m").unionByName(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
    least = both.groupBy("v").agg(F.min("m").alias("least"))
    large = (
        both.join(least, "v")
        .filter("m > v")
        .select(F.col("m").alias("v"), F.least("v", "least").alias("m"))
        .distinct()
    )
    least = large.groupBy("v").agg(F.min("m").alias("least"))
    hung = large.join(least, "v").filter("m <> least").select(F.col("m").alias("v"), F.col("least").alias("m"))
    return hung.unionByName(least.select("v", F.col("least").alias("m"))).distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node reachable.

    Self loops and nulls are ignored; an empty edge table gives an empty result. Every round cuts
    lineage by a reliable checkpoint. Only two numbers a round reach the driver. A path of n nodes
    needs O(log n) rounds; not converging within ``max_rounds`` raises.
    """
    checkpoint_dir(edges.sparkSession)
    now = (
        edges.select(F.greatest(a, b).cast("long").alias("v"), F.least(a, b).cast("long").alias("m"))
        .filter("v > m")
        .distinct()
        .checkpoint()
    )
    before = _state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        now = _round(now).checkpoint()
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    roots = now.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("m").alias("component")))


def smallest_linked(n: int, tiles: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``n`` nodes the smallest it is connected to. A tile is (rows, columns, links): two arrays
    of nodes and a boolean matrix, its columns packed to bits. Roots hook to smaller labels, then labels jump."""
    label = np.arange(n)
    while True:
        before = label.copy()
        for rows, cols, bits in tiles:
            near = np.unpackbits(bits, axis=1, count=len(cols)).view(bool)
            x, y = label[rows], label[cols]
            low, high = np.where(near, y[None, :], n).min(axis=1), np.where(near, x[:, None], n).min(axis=0)
            for mine, own, seen in ((rows, x, low), (cols, y, high)):
                hit = seen < n
                np.minimum.at(label, own[hit], seen[hit])
                np.minimum.at(label, mine[hit], seen[hit])
        while ((jumped := label[label]) != label).any():
            label = jumped
        if (label == before).all():
            return label
