"""SimHash near-dedup with pigeonring filtering.

A fingerprint's 64 bits are cut into ``segments`` segments that form a ring. If two fingerprints
differ in at most t bits, the pigeonring principle says that from some segment on every chain of
l consecutive segments differs in at most floor(l * t / segments) bits. With 5 segments and t = 2
the budgets are 0, 0, 1, 1, 2: two consecutive segments agree. Those two are the join key, the
longer chains prune what shares it, and only survivors get the full Hamming check.

Skew: exact copies collapse to one fingerprint row before any join (map-side combine). A block,
that is the fingerprints sharing one key, is joined in pairs only up to ``block_cap`` rows. Larger
blocks are linked exactly and in linear space: two fingerprints are within 2 bits just when they
have a common neighbour within 1 bit, so each row emits itself and its one-bit variants outside
the key, and rows meeting at one variant hang on the smallest of them.

Defined results: null or blank texts have fingerprint zero and link with each other like any other
value; repeated rows and ties share a component; an empty table gives an empty result; columns of
the input other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.components import components
from tesserae.runtime import discard, settle, ship

BITS, SEED, SLAB = 64, 42, 1 << 16


def text_fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 (seed 42) of the 3-word shingles, as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()  # bytes.lower and bytes.split know ASCII only
    if not words:
        return 0
    n = max(1, len(words) - 2)
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, SLAB):
        part = words[at : at + SLAB + 2]
        grams = [b" ".join(x) for x in zip(part, part[1:], part[2:], strict=False)] if len(words) > 2 else [b" ".join(part)]
        raw = np.frombuffer(b"".join([digest(g, SEED) for g in grams]), np.uint8)
        ones += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = pa.array([text_fingerprint(t.as_py()) for t in batch.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), prints], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` for every row of ``docs``."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _fingerprints, "id long, fp long"
    )


def _bounds(segments: int) -> list[tuple[int, int]]:
    cut = [round(i * BITS / segments) for i in range(segments + 1)]
    return [(cut[i], cut[i + 1] - cut[i]) for i in range(segments)]


def _segment(fp, at: int, width: int):
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _chains_hold(parts: list, first: int, limit: int):
    """Every chain from segment ``first`` stays within its proportional budget; ``parts``: the bits that differ in each."""
    total, ok = F.lit(0), F.lit(True)
    for length in range(1, len(parts) + 1):
        total = total + parts[(first + length - 1) % len(parts)]
        ok = ok & (total <= length * limit // len(parts))
    return ok


def chains_hold(words: list, segments: int, limit: int):
    """Whether from some segment on every chain stays within its proportional budget; ``words`` are the
    differing bits of a fingerprint, 64 a word, with the segments spread evenly over the words."""
    each = segments // len(words)
    parts = [F.bit_count(_segment(word, *bound)) for word in words for bound in _bounds(each)]
    holds = F.lit(False)
    for first in range(segments):
        holds = holds | _chains_hold(parts, first, limit)
    return holds


def links(
    prints: DataFrame, segments: int = 5, limit: int = 2, block_cap: int = 128, scratch: list[DataFrame] | None = None
) -> DataFrame:
    """Edges ``(a, b)`` between distinct values of column ``fp`` whose components are those of all
    pairs within ``limit`` bits; every edge of a block within the cap is itself such a pair.

    The exact way for large blocks needs ``limit`` = 2; other limits take pairs in every block.
    """
    bounds = _bounds(segments)
    lead = max(1, next(n - 1 for n in range(1, segments + 2) if n * limit // segments > 0))
    keys = []
    for i in range(segments):
        key = F.lit(0).cast("long")
        for j in range(lead):
            at, width = bounds[(i + j) % segments]
            key = F.shiftleft(key, width).bitwiseOR(_segment(F.col("fp"), at, width))
        keys.append(F.struct(F.lit(i).alias("ring"), key.alias("key")))
    rows = prints.select("fp", F.inline(F.array(*keys)))
    sizes = rows.groupBy("ring", "key").agg(F.count("*").alias("n")).filter("n > 1")
    if limit != 2:
        block_cap = 1 << 62
    blocks = settle(rows.join(sizes, ["ring", "key"]), "simhash-blocks", scratch)
    small = blocks.filter(F.col("n") <= block_cap)
    left = small.select("ring", "key", F.col("fp").alias("a"))
    right = small.select(F.col("ring").alias("r2"), F.col("key").alias("k2"), F.col("fp").alias("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    holds, parts = F.lit(False), [F.bit_count(_segment(diff, *bound)) for bound in bounds]
    for i in range(segments):
        holds = holds | ((F.col("ring") == i) & _chains_hold(parts, i, limit))
    pairs = left.join(
        right,
        (F.col("ring") == F.col("r2"))
        & (F.col("key") == F.col("k2"))
        & (F.col("a") < F.col("b"))
        & holds
        & (F.bit_count(diff) <= limit),
    ).select("a", "b")
    if limit != 2:
        return pairs.distinct()
    flips = []
    for bit in range(BITS):
        owner = next(i for i, (at, width) in enumerate(bounds) if at <= bit < at + width)
        outside = ~F.col("ring").isin([(owner - j) % segments for j in range(lead)])
        mask = 1 << bit if bit < 63 else -(1 << 63)
        flips.append(F.when(outside, F.col("fp").bitwiseXOR(F.lit(mask).cast("long"))))
    near = (
        blocks.filter(F.col("n") > block_cap)
        .select("ring", "key", "fp", F.explode(F.array_compact(F.array(F.col("fp"), *flips))).alias("variant"))
    )
    hubs = near.groupBy("ring", "key", "variant").agg(F.min("fp").alias("a"))
    stars = near.join(hubs, ["ring", "key", "variant"]).filter("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    segments: int = 5,
    limit: int = 2,
    block_cap: int = 128,
) -> DataFrame:
    """``(id, fp, component_id)`` for every row: the smallest id reachable over links of at most
    ``limit`` differing bits. A null id is kept as a row and takes part through its fingerprint."""
    prints = settle(fingerprints(docs, id_col, text_col), "simhash-prints")
    classes = settle(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    scratch: list[DataFrame] = []
    found = components(links(classes, segments, limit, block_cap, scratch), "a", "b")
    discard(scratch)
    roots = classes.join(found, F.col("node") == F.col("fp"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    # settled, so that the join is a stage of its own whose partitions Spark may split: blank texts may be one hot fingerprint
    labels = settle(roots.join(named, "root").select("fp", "component_id"), "simhash-labels")
    discard([classes])
    return prints.join(labels, "fp").select("id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
