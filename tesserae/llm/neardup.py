"""SimHash near-dedup of whole texts: five-word shingles, pigeonring over segments, exact Jaccard of ``LEAST`` or more.

The text form of ``simhash``. Two texts of similarity 0.8 differ in about 15 % of the bits of a SimHash
(``AGREE``), far more than a short ring can promise a whole agreeing segment for. So the fingerprint is
long: ``segments_for`` gives it as many segments as bring the chance that a pair of exactly 0.8 agrees in
none down to ``MISS`` (54 of 8 bits; 113 of 12 bits for tables of over 2 million rows, 225 of 16 bits over 32
million). Segments are the key that brings candidates together. Rows that share one are compared inside a
task on the first ``BITS`` bits, a ring of ``RING`` segments: sizes, the whole distance of at most ``LIMIT`` bits
(a pair of 0.8 exceeds it with a chance below ``MISS``), and from some segment on every chain within its
proportional budget. Only survivors' texts are fetched and settled by the Jaccard similarity of their
shingles. Texts of 4 or 5 shingles differ in up to 19 % of the bits, which raises both chances to 1e-5.

Skew: texts with the same shingles collapse to one row before any join. The blocks are compared twice. A row
with more than ``block_cap`` close rows in a block is crowded: the first time, crowded rows that are close hang
on one of them. Blocks of more than ``block_most`` rows hang the rows close to one hub on it; the others
are compared with these in tiles of ``TILE`` against ``TILE`` rows and among each other as a block of their own.
What hangs together over all blocks is a crowd. The second time rows carry their crowd, and only pairs of
different crowds come out; a row of none is a crowd of its own. Where the links found to a crowd's hubs leave
it in several components, the rows outside its largest one are compared with all its rows, ``CHUNK`` against
``CHUNK`` rows in a task, by the same ring and then products of incidence matrices. That step is
linear in a crowd of near copies and grows with the rows that are unlike their crowd.

Defined results: words are split at ASCII white space and lower-cased in ASCII; a text under five
words is one shingle; null and blank texts have none and are copies of each other. One row of each
component stays, that with the smallest id; null ids come last, ties go by content, and of rows
that agree in every column one stays. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.components import components, smallest_linked
from tesserae.llm.simhash import chains_hold
from tesserae.runtime import discard, settle, ship, sized_broadcast

WORDS, LEAST = 5, 0.8
AGREE, MISS = 0.8485, 5e-8
BITS, RING, LIMIT = 192, 12, 60
CHUNK, COLUMNS, TILE, STRIP, PEELS, HUBS = 512, 4096, 8192, 512, 8, 4
_SALT = np.random.default_rng(5).integers(0, 1 << 64, 64, np.uint64)
_NEAR = "a long, b long, kind int"
WORD_COLS = ["f1", "f2", "f3"]
#: What two rows of a block are to each other: candidates, hub and close row of a crowd, hub and other row of a crowd.
PAIR, STAR, MEMBER = 0, 1, 2


def segments_for(rows: int) -> tuple[int, int]:
    """Width and number of a fingerprint's segments for a table of ``rows`` rows: wider ones keep blocks short."""
    width = 8 if rows <= 1 << 21 else 12 if rows <= 1 << 25 else 16
    return width, math.ceil(math.log(MISS) / math.log1p(-(AGREE**width)))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles."""
    words = (text or "").encode().lower().split()  # bytes.lower and bytes.split know ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.array([digest(join(words[i : i + WORDS])) for i in range(max(1, len(words) - WORDS + 1))], np.uint64))


def fingerprint(found: np.ndarray, n_bits: int) -> np.ndarray:
    """Majority bits of the shingles' hashes, ``n_bits`` of them, as booleans."""
    salt = _SALT[: -(-n_bits // 64)]
    ones = np.zeros(64 * len(salt), np.int64)
    for at in range(0, len(found), 255):  # 255 ones fit a byte
        raw = found[at : at + 255, None] ^ salt
        for shift, factor in ((29, 0x9E3779B97F4A7C15), (32, 0xD6E8FEB86659FD93), (29, 1)):
            raw = (raw ^ (raw >> np.uint64(shift))) * np.uint64(factor)
        ones += np.add.reduce(np.unpackbits(raw.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return (ones * 2 > len(found))[:n_bits]


def segment_keys(bits: np.ndarray, width: int) -> list[int]:
    """A key for each segment: its number and its bits."""
    parts = bits.reshape(-1, width) @ (1 << np.arange(width))
    return ((np.arange(len(parts)) << width) + parts).tolist()


def ring_holds(words: np.ndarray) -> np.ndarray:
    """For rows of differing bits: whether from some segment on every chain stays within its proportional budget."""
    parts = np.bitwise_count(np.ascontiguousarray(words).view(np.uint16)).astype(np.int64)
    budget = np.arange(1, RING + 1) * LIMIT // RING
    holds = np.zeros(len(parts), bool)
    for first in range(RING):
        holds |= (np.roll(parts, -first, axis=1).cumsum(axis=1) <= budget).all(axis=1)
    return holds


def close(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Boolean matrix: which rows (size and the words of the first ``BITS`` bits) pass what a pair of similarity ``LEAST`` passes."""
    far = sum(np.bitwise_count(left[:, None, w] ^ right[None, :, w]) for w in range(1, left.shape[1]))
    n, m = left[:, 0].astype(np.float64)[:, None], right[:, 0].astype(np.float64)[None, :]
    near = (far <= LIMIT) & (n >= m * LEAST) & (m >= n * LEAST)
    i, j = near.nonzero()
    for at in range(0, len(i), 1 << 20):
        some = slice(at, at + (1 << 20))
        near[i[some], j[some]] = ring_holds(left[i[some], 1:] ^ right[j[some], 1:])
    return near


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= LEAST * (len(a) + len(b) - both)


def _signer(width: int, segments: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    n_bits = max(BITS, width * segments)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys, prints = [], [], [], []
            for cell in batch.column(3):
                found = shingles(cell.as_py())
                bits = fingerprint(found, n_bits)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63))
                sizes.append(len(found))
                keys.append(segment_keys(bits[: width * segments], width) if len(found) else [])
                prints.append(np.packbits(bits[:BITS]).view(np.int64))
            words = np.array(prints, np.int64).reshape(-1, BITS // 64)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int32())),
                    *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(BITS // 64)),
                ],
                ["id", "k1", "k2", "node", "size", "keys", *WORD_COLS],
            )

    return sign


def _strips(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The close pairs of a block, each once: rows, columns and their boolean matrix, a strip of rows at a time."""
    side, marks = rows[:, 1], np.ascontiguousarray(rows[:, 4:]).view(np.uint64)
    for at in range(0, len(rows), STRIP):
        end = min(at + STRIP, len(rows))
        top = int(np.searchsorted(rows[:, 4], rows[end - 1, 4] / LEAST + 1, "right"))
        near = close(marks[at:end], marks[at:top])
        near &= (side[at:end, None] != side[None, at:top]) | (side[at:end, None] == 0)
        near &= np.arange(at, end)[:, None] < np.arange(at, top)[None, :]
        if near.any():
            yield np.arange(at, end), np.arange(at, top), near


def crowds_in(cap: int) -> Callable[[np.ndarray], list[np.ndarray]]:
    """A block to its crowds: the rows with more than ``cap`` close rows, those that hang together on one of them."""

    def find(rows: np.ndarray) -> list[np.ndarray]:
        if len(rows) <= cap:
            return []
        node, marks = rows[:, 2], np.ascontiguousarray(rows[:, 4:]).view(np.uint64)
        degree, strips = np.zeros(len(rows), np.int64), []
        for x, y, near in _strips(rows):
            degree[x] += near.sum(axis=1)
            degree[y] += near.sum(axis=0)
            strips.append((x, y, np.packbits(near, axis=1)))
        crowded = degree > cap
        if not crowded.any():
            return []
        tiles, out, place = [], [], np.cumsum(crowded) - 1
        for x, y, packed in strips:
            u, v = crowded[x], crowded[y]
            if u.any():
                near = np.unpackbits(packed, axis=1, count=len(y))[u][:, v]
                tiles.append((place[x[u]], place[y[v]], np.packbits(near, axis=1)))
        who = crowded.nonzero()[0]
        root = smallest_linked(len(who), tiles)
        order = np.lexsort((node[who], degree[who], root))
        last = np.append(root[order][1:] != root[order][:-1], True)
        hub = np.zeros(len(who), np.int64)
        hub[root[order][last]] = who[order][last]
        for h in np.unique(hub[root]):
            mine = who[hub[root] == h]
            kind = np.where(close(marks[h : h + 1], marks[mine])[0], STAR, MEMBER)
            out.append(np.stack([np.full(len(mine), node[h]), node[mine], kind], axis=1))
        return out

    return find


def pairs_in(rows: np.ndarray) -> list[np.ndarray]:
    """A block to its close pairs of different crowds."""
    node, crowd, out = rows[:, 2], rows[:, 3], []
    for x, y, near in _strips(rows):
        i, j = (near & (crowd[x, None] != crowd[None, y])).nonzero()
        a, b = node[x[i]], node[y[j]]
        out.append(np.stack([np.minimum(a, b), np.maximum(a, b), np.full(len(a), PAIR)], axis=1))
    return out


def _by_block(compare: Callable[[np.ndarray], list[np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``compare`` on each block of rows sorted by block and size; rows of side 0 meet all others, of sides 1 and 2 those across."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            found: list[np.ndarray] = []
            cut = (rows[1:, 0] != rows[:-1, 0]).nonzero()[0] + 1
            for block in np.split(rows, cut):
                if len(block) > 1:
                    found += compare(block)
            for at in range(0, len(found), 64):
                some = np.unique(np.concatenate(found[at : at + 64]), axis=0)
                cols = [pa.array(np.ascontiguousarray(some[:, 0])), pa.array(np.ascontiguousarray(some[:, 1])), pa.array(some[:, 2].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["a", "b", "kind"])

        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if held and len(rows) and rows[-1, 0] != held[0][-1, 0]:
                start = int((rows[:, 0] != rows[-1, 0]).sum())
                yield from emit(np.concatenate([*held, rows[:start]]))
                held, rows = [], rows[start:]
            if len(rows):
                held.append(rows)
        if held:
            yield from emit(np.concatenate(held))

    return near


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, held = None, None
    for batch in batches:
        keep = []
        for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if held is None or a != last:
                last, held = a, shingles(ta.as_py())
            keep.append(similar(held, shingles(tb.as_py())))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def similar_in_chunks(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Boolean matrix: which sets of hashes of the two lists are similar."""
    every, times = np.unique(np.concatenate([*left, *right, np.zeros(0, np.uint64)]), return_counts=True)
    every = every[times > 1]  # a hash in one set only is in no intersection
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(every), COLUMNS):
        some = every[at : at + COLUMNS]
        marks = []
        for sets in (left, right):
            mark = np.zeros((len(sets), len(some)), np.float32)
            for i, x in enumerate(sets):
                place = np.minimum(np.searchsorted(some, x), len(some) - 1)
                mark[i, place[some[place] == x]] = 1
            marks.append(mark)
        both += marks[0] @ marks[1].T
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return both >= LEAST * (sizes - both.astype(np.float64))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by crowd, l, o: loose rows (side 0) against rows of the crowd; out: a spanning set of links.

    The ring first; only rows that it leaves a partner are compared by their shingles."""

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        sides = [[r for r in rows if r[3] == side] for side in (0, 1)]
        near = np.zeros((0, 0), bool)
        if all(sides):
            marks = [np.array([r[5] for r in side], np.int64).view(np.uint64) for side in sides]
            hope = close(*marks)
            sides = [[r for r, some in zip(side, hope.any(axis=1 - k), strict=True) if some] for k, side in enumerate(sides)]
            hope = hope[hope.any(axis=1)][:, hope.any(axis=0)]
            near = similar_in_chunks(*[[shingles(r[6].as_py()) for r in side] for side in sides]) & hope if hope.size else hope
        pairs: list[tuple] = []
        if near.any():
            nodes = sorted({r[4] for r in rows})
            place = {x: i for i, x in enumerate(nodes)}
            ends = [np.array([place[r[4]] for r in side]) for side in sides]
            root = smallest_linked(len(nodes), [(*ends, np.packbits(near, axis=1))])
            pairs = [(x, nodes[root[i]]) for i, x in enumerate(nodes) if root[i] != i]
        cols = list(zip(*pairs, strict=True)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    held: list[tuple] = []
    for batch in batches:
        marks = zip(*(c.to_pylist() for c in batch.columns[5:-1]), strict=True)
        for row, mark, text in zip(zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True), marks, batch.column(batch.num_columns - 1), strict=True):
            if held and row[:3] != held[-1][:3]:
                yield emit(held)
                held = []
            held.append((*row, mark, text))
    if held:
        yield emit(held)


def _row_keys(columns: list[str]) -> list[Column]:
    """128 bits over every column, nulls told apart."""
    cells = [x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return [F.xxhash64(*cells), F.xxhash64(F.lit(1), *reversed(cells))]


def _texts(nodes: DataFrame, classes: DataFrame, keyed: DataFrame, text_col: str, scratch: list[DataFrame]) -> DataFrame:
    """``(node, t)`` of the nodes, each once: rows that agree in every column come more than once."""
    wanted = classes.join(nodes, "node").select("node", F.col("first.k1").alias("__k1"), F.col("first.k2").alias("__k2"))
    texts = keyed.join(wanted, ["__k1", "__k2"]).select("node", F.col(f"`{text_col}`").alias("t"))
    return settle(texts.dropDuplicates(["node"]), "neardup-texts", scratch)


def _verified(pairs: DataFrame, classes: DataFrame, keyed: DataFrame, text_col: str, scratch: list[DataFrame]) -> DataFrame:
    """The candidate pairs whose texts are similar."""
    pairs = settle(pairs.select("a", "b").distinct(), "neardup-pairs", scratch)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = _texts(nodes, classes, keyed, text_col, scratch)
    left, right = texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), texts.select(F.col("node").alias("b"), F.col("t").alias("tb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return settle(both.mapInArrow(_check, "a long, b long"), "neardup-edges", scratch)


def _fits(a: str, b: str) -> Column:
    """``close`` as an expression over two structs."""
    size = F.least(f"{a}.size", f"{b}.size") >= F.greatest(f"{a}.size", f"{b}.size") * LEAST
    words = [F.col(f"{a}.{f}").bitwiseXOR(F.col(f"{b}.{f}")) for f in WORD_COLS]
    return size & (reduce(Column.__add__, [F.bit_count(w) for w in words]) <= LIMIT) & chains_hold(words, RING, LIMIT)


def _blocks(classes: DataFrame, most: int, scratch: list[DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """The rows that share a segment as blocks, and for blocks of more than ``most`` rows the hub with the rows close to it."""
    mark = ["node", "crowd", "size", *WORD_COLS]
    rest = classes.select(F.explode(F.col("keys").cast("array<long>")).alias("key"), *mark)
    blocks, stars = [], []

    def block(df: DataFrame, group: Column, side: int) -> None:
        blocks.append(df.select(group.alias("block"), F.lit(side).alias("side"), *mark))

    def chunks(n: str) -> Column:
        return F.ceil(F.col(n) / TILE).cast("int")

    for peel in range(PEELS):
        sizes = settle(rest.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most), "neardup-sizes", scratch)
        own = F.col("key") if not peel else F.xxhash64(F.lit(peel), "key")
        if sizes.isEmpty():
            break
        few = sized_broadcast(sizes)
        block(rest.join(few, "key", "left_anti"), own, 0)
        large = settle(rest.join(few, "key"), "neardup-large", scratch)
        known = large.groupBy("node").agg(F.sum("n").alias("known"))
        one = F.struct(*mark)
        hubs = large.join(known, "node").groupBy("key").agg(F.max_by(one, F.struct("known", "node")).alias("hub"))
        hung = large.join(sized_broadcast(settle(hubs, "neardup-hubs", scratch)), "key").withColumn("one", one)
        hung = settle(hung.withColumn("fit", _fits("hub", "one")).drop("one"), "neardup-hung", scratch)
        stars.append(hung.filter("fit").select(F.col("hub.node").alias("a"), F.col("node").alias("b"), F.lit(STAR).alias("kind")))
        sums = hung.groupBy("key").agg(F.sum(F.col("fit").cast("long")).alias("near"), F.sum((~F.col("fit")).cast("long")).alias("far"))
        split = hung.join(sized_broadcast(settle(sums.filter("far > 0"), "neardup-sums", scratch)), "key")
        mine = lambda n: F.pmod(F.xxhash64("node"), chunks(n)).cast("int")
        against = lambda n: F.explode(F.sequence(F.lit(0), chunks(n) - 1))
        tile = F.xxhash64(F.lit(-1 - peel), "key", "l", "o")
        block(split.filter("not fit").select("*", mine("far").alias("l"), against("near").alias("o")), tile, 1)
        block(split.filter("fit").select("*", against("far").alias("l"), mine("near").alias("o")), tile, 2)
        rest = split.filter("not fit").select("key", *mark)
    block(rest, F.col("key") if not stars else F.xxhash64(F.lit(len(stars)), "key"), 0)
    return reduce(DataFrame.unionByName, blocks), stars


def _candidates(classes: DataFrame, cap: int, most: int, scratch: list[DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For the rows that share a segment and are close: hubs and their rows ``(a, b, kind)``, the crowds
    ``(node, crowd)`` these make, and the pairs ``(a, b)`` of different crowds. The crowds come first, so that
    no pair of one is ever a row."""

    def within(blocks: DataFrame, compare: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
        dealt = blocks.repartition("block").sortWithinPartitions("block", "size", "node")
        return dealt.select("block", "side", "node", "crowd", "size", *WORD_COLS).mapInArrow(_by_block(compare), _NEAR)

    first: list[DataFrame] = []
    blocks, stars = _blocks(classes.withColumn("crowd", F.col("node")), most, first)
    hung = settle(reduce(DataFrame.unionByName, [within(blocks, crowds_in(cap)), *stars]).distinct(), "neardup-near", scratch)
    discard(first)
    crowds = settle(components(hung, "a", "b").select("node", F.col("component").alias("crowd")), "neardup-crowds", scratch)
    known = classes.join(sized_broadcast(crowds), "node", "left").withColumn("crowd", F.coalesce("crowd", "node"))
    blocks, _ = _blocks(known, most, scratch)
    return hung, crowds, within(blocks, pairs_in).select("a", "b")


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_cap: int = 32, block_most: int = TILE
) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component of similar texts."""
    ship(docs.sparkSession)
    scratch: list[DataFrame] = []
    n_rows = docs.count()
    width, segments = segments_for(n_rows)
    k1, k2 = _row_keys(docs.columns)
    keyed = docs.withColumns({"__k1": k1, "__k2": k2})
    words = ", ".join(f"{f} long" for f in WORD_COLS)
    signed = settle(
        keyed.select(
            F.col(f"`{id_col}`").cast("long").alias("id"), F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col(f"`{text_col}`").alias("t")
        ).mapInArrow(_signer(width, segments), f"id long, k1 long, k2 long, node long, size long, keys array<int>, {words}"),
        "neardup-signed",
        scratch,
    )
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2")
    same = [F.first(c).alias(c) for c in ("keys", *WORD_COLS)]
    classes = settle(signed.groupBy("node", "size").agg(F.min(order).alias("first"), *same), "neardup-classes", scratch)
    hung, crowds, pairs = _candidates(classes, block_cap, max(block_most, 4 * n_rows >> width), scratch)
    crowded = not crowds.isEmpty()
    if crowded:
        stars = hung.filter((F.col("kind") == STAR) & (F.col("a") != F.col("b")))
        liked = stars.join(stars.groupBy("a").agg(F.count("*").alias("n")), "a").groupBy("b")
        liked = liked.agg(F.slice(F.sort_array(F.collect_set(F.struct("n", "a")), asc=False), 1, HUBS).alias("hubs"))
        liked = liked.select("b", F.explode("hubs.a").alias("a"))
        pairs = pairs.unionByName(liked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    edges = _verified(pairs, classes, keyed, text_col, scratch)
    found = components(edges, "a", "b")
    if crowded:
        parts = crowds.join(found, "node", "left").select("node", "crowd", F.coalesce(found["component"], "node").alias("part"))
        parts = settle(parts, "neardup-parts", scratch)
        sums = parts.groupBy("crowd", "part").agg(F.count("*").alias("n"))
        sums = sums.groupBy("crowd").agg(
            F.max_by("part", F.struct("n", "part")).alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("loose")
        )
        split = parts.join(settle(sums.filter("loose > 0"), "neardup-sums", scratch), "crowd")
        chunks = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
        mine = lambda n: F.pmod(F.xxhash64("node"), chunks(n)).cast("int")
        split = settle(split.select("*", mine("loose").alias("l"), mine("all").alias("o")), "neardup-split", scratch)
        against = lambda n: F.explode(F.sequence(F.lit(0), chunks(n) - 1))
        texts = _texts(split.select("node").distinct(), classes, keyed, text_col, scratch)
        placed = split.join(texts, "node").join(classes.select("node", "size", *WORD_COLS), "node")
        groups = placed.filter("part <> main").select("crowd", "l", against("all").alias("o"), F.lit(0).alias("side"), "node", "size", *WORD_COLS, "t")
        groups = groups.unionByName(placed.select("crowd", against("loose").alias("l"), "o", F.lit(1).alias("side"), "node", "size", *WORD_COLS, "t"))
        links = groups.repartition("crowd", "l", "o").sortWithinPartitions("crowd", "l", "o").mapInArrow(_compare, "a long, b long")
        edges = edges.unionByName(settle(links, "neardup-links", scratch))
        found = components(edges, "a", "b")
    roots = classes.join(found, "node", "left").select("first", F.coalesce("component", "node").alias("root"))
    stay = settle(roots.groupBy("root").agg(F.min("first").alias("first")).select("first.k1", "first.k2"), "neardup-stay")
    discard(scratch)
    stay = stay.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    kept = keyed.join(stay, ["__k1", "__k2"], "left_semi")
    return kept.dropDuplicates(["__k1", "__k2"]).drop("__k1", "__k2")
