"""Embedding near-dedup with a forest of random-projection trees.

Every tree splits recursively at medians of random projections, one direction a level; vectors
within ``spill`` of a threshold go to both sides. The forest is fitted on at most ``SAMPLE`` unit
vectors, the ones with the smallest hashes of a fixed share. Down to ``FITTED`` levels every node
has a threshold of its own; below, a node takes the median of its ancestor on that level along its
own direction, so thresholds never outgrow ``TREES`` * 2**FITTED * levels numbers, whatever the
table. Every vector is then sent to its leaves in every tree. Inside a leaf all pairs are compared
by cosine in double precision, so a link is always a verified pair. A pair that meets in several
leaves is counted only in the first leaf (tree by tree) that the two have in common, so link counts
are sums of partial counts and no pair is ever shuffled; for the union each leaf gives one edge a
vector, to the smallest vector it is connected to there.

Skew: exact copies collapse to one row with a multiplicity before anything else. A leaf of more
than ``LEAF_CAP`` rows is compared in pairs of blocks, each pair of blocks a group of its own, so a
group is bounded whatever the data; all pairs of the leaf are still compared. Inside a group links
are boolean matrices, so a group of near copies costs no more than one of strangers.

Recall: with the default spill of a quarter of the standard deviation of the projected distance of
two vectors at the threshold, such a pair is parted at a level with a chance of about 5 %; with
``TREES`` trees of 12 levels the chance to part in all of them is under 1 %, less for closer pairs.

Defined results: vectors that are null, all zero, or hold a null or non-finite component link with
nothing and stay; vectors of different length link with nothing; copies link with each other;
repeated rows are copies; a null id counts as larger than any other, and a component of null ids
alone has a null component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.components import components, smallest_linked
from tesserae.runtime import discard, settle, ship, sized_broadcast

TREES, LEAF, LEAF_CAP, SAMPLE, FITTED, STEP, SEED = 6, 1024, 4096, 32_768, 11, 1024, 7


class Forest:
    """Directions by tree and level; thresholds by tree and node down to ``FITTED`` levels, below that by
    tree, level and ancestor. A node is the path to it, one bit a level."""

    def __init__(self, sample: np.ndarray, dim: int, depth: int, trees: int, spill: float):
        rng = np.random.default_rng([SEED, dim])
        self.depth, self.spill, self.fitted = depth, spill, min(depth, FITTED)
        way = rng.standard_normal((trees, max(depth, 1), dim))
        self.ways = way / np.linalg.norm(way, axis=2, keepdims=True)
        self.cuts: list[list[np.ndarray]] = [[] for _ in range(trees)]
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for level in range(depth):
                p = sample @ self.ways[t, level]
                cut = self._medians(p, node, 1 << min(level, self.fitted))
                self.cuts[t].append(cut)
                if level < self.fitted:
                    node = 2 * node + (p > cut[node])

    @staticmethod
    def _medians(p: np.ndarray, node: np.ndarray, nodes: int) -> np.ndarray:
        """The median of ``p`` in each node; that of all where a node is empty."""
        if not len(p):
            return np.zeros(nodes)
        order = np.lexsort((p, node))
        ends = np.searchsorted(node[order], np.arange(nodes), side="right")
        begins = np.concatenate([[0], ends[:-1]])
        middle = np.minimum((begins + ends) // 2, len(p) - 1)
        return np.where(ends > begins, p[order][middle], np.median(p))

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs, rows ascending and each row's leaves ascending; leaves are numbered
        through all trees."""
        rows, found = [], []
        for t in range(len(self.ways)):
            row, node = np.arange(len(unit)), np.zeros(len(unit), np.int64)
            for level in range(self.depth):
                p = (unit @ self.ways[t, level])[row]
                cut = self.cuts[t][level][node >> max(0, level - self.fitted)]
                left, right = p <= cut + self.spill, p > cut - self.spill
                row = np.concatenate([row[left], row[right]])
                node = np.concatenate([2 * node[left], 2 * node[right] + 1])
            rows.append(row)
            found.append(node + (t << self.depth))
        row, leaf = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _met_before(rows: slice, cols: slice, row: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Boolean matrix: which pairs of a row and a column share a leaf of the (row, leaf) list."""
    out = np.zeros((rows.stop - rows.start, cols.stop - cols.start), bool)
    mine, theirs = ((row >= s.start) & (row < s.stop) for s in (rows, cols))
    both = np.intersect1d(home[mine], home[theirs])
    width = 512
    for at in range(0, len(both), width):
        some = both[at : at + width]
        marks = []
        for s, chosen in ((rows, mine), (cols, theirs)):
            place = np.searchsorted(some, home[chosen])
            hit = (place < len(some)) & (some[np.minimum(place, len(some) - 1)] == home[chosen])
            mark = np.zeros((s.stop - s.start, len(some)), np.float32)
            mark[row[chosen][hit] - s.start, place[hit]] = 1
            marks.append(mark)
        out |= marks[0] @ marks[1].T > 0
    return out


def compare_leaf(
    leaf: int, cid: np.ndarray, unit: np.ndarray, copies: np.ndarray, homes: np.ndarray, sizes: np.ndarray, second: np.ndarray | None, threshold: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cid, copies of the vectors linked first in this leaf, smallest cid connected here; of the rows with a link.

    ``homes`` holds the rows' leaves end to end, ``sizes`` how many each has. With ``second``, which marks
    the rows of a second block, only pairs across the two blocks count."""
    whole = second is None
    second = np.zeros(len(cid), bool) if whole else second
    order = np.argsort(second, kind="stable")
    row = np.repeat(np.argsort(order), sizes)[homes < leaf]
    home = homes[homes < leaf]
    cid, unit, copies = cid[order], unit[order], copies[order]
    n, half = len(cid), len(cid) - int(second.sum())
    count, touched = np.zeros(n, np.int64), np.zeros(n, bool)
    links: list[tuple[slice, slice, np.ndarray]] = []
    for a in range(0, n if whole else half, STEP):
        rows = slice(a, min(a + STEP, n if whole else half))
        for b in range(a if whole else half, n, STEP):
            cols = slice(b, min(b + STEP, n))
            near = unit[rows] @ unit[cols].T >= threshold
            if whole and a == b:
                near = np.triu(near, 1)
            if not near.any():
                continue
            touched[rows] |= near.any(axis=1)
            touched[cols] |= near.any(axis=0)
            links.append((rows, cols, np.packbits(near, axis=1)))
            fresh = (near & ~_met_before(rows, cols, row, home)).astype(np.float32)
            for digit in range(0, int(copies.max()).bit_length(), 12):  # sums of 12-bit digits are exact in float32
                some = ((copies >> digit) & 4095).astype(np.float32)
                count[rows] += (fresh @ some[cols]).astype(np.int64) << digit
                count[cols] += (some[rows] @ fresh).astype(np.int64) << digit
    by_cid = np.argsort(cid)
    rank = np.argsort(by_cid)
    label = smallest_linked(n, [(rank[rows], rank[cols], bits) for rows, cols, bits in links])
    at = np.flatnonzero(touched)
    return cid[at], count[at], cid[by_cid[label[rank[at]]]]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of an array column end to end, and how many each row has."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _compare(threshold: float):
    """Rows sorted by dim, leaf, b1, b2; a group of one leaf and pair of blocks at a time."""

    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=1 << 30)[0]
        column = {name: rows.column(i) for i, name in enumerate(rows.schema.names)}
        flat, _ = _lists(column["v"])
        homes, sizes = _lists(column["homes"])
        found = compare_leaf(
            column["leaf"][0].as_py(),
            column["cid"].to_numpy(),
            _units(flat.astype(np.float64).reshape(-1, column["dim"][0].as_py())),
            column["copies"].to_numpy(),
            homes,
            sizes,
            None if column["b1"][0] == column["b2"][0] else column["mine"].to_numpy() != column["b1"].to_numpy(),
            threshold,
        )
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["cid", "n", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tuple(keys[a]) != last:
                    if sum(x.num_rows for x in held) > 1:
                        yield emit(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = tuple(keys[a])
        if sum(x.num_rows for x in held) > 1:
            yield emit(held)

    return run


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    leaf: int = LEAF,
    sample: int = SAMPLE,
    spill: float = 0.25,
) -> DataFrame:
    """``(id, n_links, component_id)``, one row per row of ``vectors``. ``spill`` is in standard
    deviations of the projected distance of two vectors at the threshold."""
    spark = vectors.sparkSession
    ship(spark)
    given, v = F.col(f"`{vector_col}`"), F.col("v")
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    usable = (
        v.isNotNull()
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), given.cast(kind).alias("v"))
    held = F.coalesce(usable, F.lit(False))
    rows = rows.select("id", "v", F.when(held, F.xxhash64("v")).alias("c1"), F.when(held, F.xxhash64(F.lit(1), "v")).alias("c2"))
    merged = rows.filter("c1 IS NOT NULL").groupBy("c1", "c2").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
    # numbered as the table is written: all that follows reads these numbers from it
    classes = settle(merged.select("*", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("cid")), "forest-classes")
    forests: dict[int, Forest] = {}
    scratch: list[DataFrame] = []
    for dim, n in classes.groupBy("dim").count().collect():  # one row per vector length
        every = max(1, math.ceil(n / sample))
        picked = classes.filter((F.col("dim") == dim) & (F.pmod("c2", F.lit(every)) == 0))
        got = picked.select("c1", "v").orderBy("c1").limit(sample).toArrow().column("v").combine_chunks()
        got = got.chunk(0) if isinstance(got, pa.ChunkedArray) else got
        fit = _units(_lists(got)[0].astype(np.float64).reshape(-1, dim)) if len(got) else np.zeros((0, dim))
        width = spill * math.sqrt(2 - 2 * threshold) / math.sqrt(dim)
        forests[dim] = Forest(fit, dim, max(0, math.ceil(math.log2(n / leaf))), trees, width)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                flat = _lists(part.column(1))[0].astype(np.float64).reshape(-1, dim)
                for at in range(0, part.num_rows, 1000):
                    some = part.slice(at, 1000)
                    row, found = forests[int(dim)].leaves(_units(flat[at : at + 1000]))
                    ends = np.searchsorted(row, np.arange(some.num_rows), side="right")
                    homes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(found))
                    yield pa.RecordBatch.from_arrays([*some.columns, homes], ["cid", "v", "copies", "dim", "homes"])

    routed = classes.select("cid", "v", "copies", "dim").mapInArrow(route, f"cid long, v {kind}, copies long, dim int, homes array<long>")
    # leaves are counted without their vectors; a crowded one is told from its size alone
    leaves = classes.select("cid", "v", "copies", "dim").mapInArrow(route, f"cid long, v {kind}, copies long, dim int, homes array<long>")
    crowded = leaves.select("dim", F.explode("homes").alias("leaf")).groupBy("dim", "leaf").agg(F.count("*").alias("n"))
    crowded = settle(crowded.filter(F.col("n") > LEAF_CAP), "forest-crowded", scratch)
    blocks = F.coalesce(F.ceil(F.col("n") * 2 / LEAF_CAP), F.lit(1)).cast("int")
    placed = routed.select("*", F.explode("homes").alias("leaf"))
    placed = placed.join(sized_broadcast(crowded), ["dim", "leaf"], "left").withColumn("blocks", blocks)
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("cid", F.lit(11)), F.col("blocks")).cast("int"))
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    parts = (
        placed.select(
            "dim", "leaf", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"),
            "cid", "v", "copies", "mine", "homes",
        )
        .repartition("dim", "leaf", "b1", "b2")
        .sortWithinPartitions("dim", "leaf", "b1", "b2")
        .mapInArrow(_compare(threshold), "cid long, n long, root long")
    )
    found = settle(parts, "forest-links", scratch)
    union = components(found, "cid", "root")
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    labels = classes.select("c1", "c2", "cid", "least", "copies").join(counts, "cid", "left")
    labels = labels.join(union, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("component", "cid"))
    named = labels.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = labels.join(named, "root").select(
        "c1", "c2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    labels = settle(labels, "forest-labels")
    discard([*scratch, classes])
    return (
        rows.select("id", "c1", "c2")
        .join(labels, ["c1", "c2"], "left")
        .select(
            "id",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )


def digest(vectors: DataFrame) -> DataFrame:
    """The contract's columns."""
    return near_duplicates(vectors).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")
    )
