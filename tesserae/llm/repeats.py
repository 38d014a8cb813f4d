"""Suffix-array dedup of repeated byte strings by prefix-free parsing.

A rolling hash over ``TRIGGER`` bytes is taken at every position. Of the hashes inside a string of
``length`` bytes the smallest is its trigger, so a trigger is chosen by content alone and every
string of that length holds one. Neighbouring strings with the same trigger form a phrase; a text
is thereby parsed into phrases that overlap by ``length`` - 1 bytes, and every starting position
lies in exactly one. Distinct phrases are the dictionary, their occurrences the parse.

Phrases overlap by ``length`` - 1 bytes, so a suffix's first ``length`` bytes lie in its own phrase:
the order of the dictionary's suffixes decides the corpus order up to there, and the order of the
parse would only part what is equal over ``length`` bytes, which is one repeat whatever follows. So
the parse contributes its counts, and no ranks of it are made. Two equal strings have the same
trigger, so corpus order is needed only inside a trigger's bucket:

* the parse counts phrases: one that occurs twice is repeated as a whole, wherever it occurs;
* in a bucket with several phrases, the suffixes of the dictionary that start before the trigger
  are sorted (a suffix array cut at ``length`` bytes), and neighbours that agree over all
  ``length`` bytes are repeats;
* buckets of more than ``BUCKET`` phrases, which one common passage can make, are ordered by
  halving instead: the strings of half a bucket's offsets share a core that contains the trigger,
  phrases that agree on the core meet under its hash, equal ones are settled at once, lone ones
  drop out, and the rest is halved again down to single positions. No task holds such a bucket.

Rows shuffled are phrases, about one in 76 bytes, as hashes; bytes are fetched only for phrases in
mixed buckets. Occurrences combine before they are shuffled. Texts are keyed by a 128-bit hash, so
exact copies share their spans and nothing depends on row order when a task is run again.

Defined results: null texts are empty; texts under ``length`` bytes keep all; repeated rows are
copies of each other and lose what they share; an empty table gives an empty result; columns other
than id and text are ignored by ``spans``. A text of any size is parsed in slabs of ``SLAB`` bytes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.runtime import discard, settle, ship

LENGTH, TRIGGER, BUCKET, SLAB = 200, 50, 2000, 1 << 21
_ROWS = "k1 long, k2 long, h long, c long, at long, m int, t int"


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte codes, powers of the base and of its inverse modulo 2**64."""
    codes = np.random.default_rng(2024).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return codes, out[0], out[1]


def _rolling(raw: np.ndarray, width: int) -> np.ndarray:
    codes, up, down = _powers(SLAB + LENGTH)
    n = len(raw)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes[raw] * up[:n], out=total[1:])
    h = (total[width:] - total[: n + 1 - width]) * down[: n + 1 - width]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    pad = -n % w
    full = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def phrases(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of texts laid end to end: first start, number of starts, trigger position, trigger hash."""
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none, none
    h = _rolling(raw, TRIGGER)
    mask = np.uint64((1 << 22) - 1)
    least = _window_min((h & ~mask) | np.arange(len(h), dtype=np.uint64), LENGTH - TRIGGER + 1)
    trigger = (least & mask).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    step = np.zeros(len(raw) + 1, np.int32)
    long = ends - begins >= LENGTH
    step[begins[long]] += 1
    step[ends[long] - LENGTH + 1] -= 1
    starts = np.flatnonzero(np.cumsum(step[: len(trigger)]) > 0)
    if not len(starts):
        return none, none, none, none
    at = trigger[starts]
    first = np.concatenate([[0], np.flatnonzero((np.diff(at) != 0) | (np.diff(starts) != 1)) + 1])
    count = np.diff(np.concatenate([first, [len(starts)]]))
    return starts[first], count, at[first], h[at[first]].view(np.int64)


def _slabs(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, list[tuple[int, int]]]]:
    """Texts laid end to end in slabs: bytes, ends, and (row, offset in its text) of each piece.
    Long texts are cut into pieces that overlap by LENGTH - 1 bytes, so no start is lost or doubled."""
    held, ends, whose, size = [], [], [], 0
    most = SLAB // 2
    for row, cell in enumerate(batch.column(2)):
        raw = (cell.as_py() or "").encode()
        for at in range(0, max(1, len(raw) - LENGTH + 1), most):
            piece = raw[at : at + most + LENGTH - 1]
            if size + len(piece) > SLAB:
                yield b"".join(held), np.array(ends, np.int64), whose
                held, ends, whose, size = [], [], [], 0
            held.append(piece)
            size += len(piece)
            ends.append(size)
            whose.append((row, at))
    if held:
        yield b"".join(held), np.array(ends, np.int64), whose


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_digest
    for batch in batches:
        k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for raw, ends, whose in _slabs(batch):
            s, m, at, h = phrases(np.frombuffer(raw, np.uint8), ends)
            if not len(s):
                continue
            stop = (s + m + LENGTH - 1).tolist()
            c = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(s.tolist(), stop, strict=True)]), ">i8")
            piece = np.searchsorted(ends, s, side="right")
            row = np.array([r for r, _ in whose])[piece]
            begin = np.concatenate([[0], ends[:-1]])[piece]
            ahead = np.array([o for _, o in whose])[piece]
            cols = [k1[row], k2[row], h, c.astype(np.int64), s - begin + ahead, m.astype(np.int32), (at - s).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], [f.split()[0] for f in _ROWS.split(", ")])


def _suffix_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by bucket in: phrases of mixed buckets; out: ranges of starts that repeat."""

    def settle_buckets(rows: list[tuple]) -> list[tuple]:
        raw = np.frombuffer(b"".join([r[6] for r in rows]), np.uint8)
        m = np.array([r[4] for r in rows])
        size = np.array([len(r[6]) for r in rows])
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(rows)), m)
        i = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)
        suffix = np.empty((len(owner), LENGTH + 8), np.uint8)
        suffix[:, :8] = np.array([r[0] for r in rows], ">i8").view(np.uint8).reshape(-1, 8)[owner]
        suffix[:, 8:] = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)[begin[owner] + i]
        flat = suffix.view(f"V{LENGTH + 8}").ravel()
        order = np.argsort(flat, kind="stable")  # corpus order of the bucket's suffixes
        ranked = suffix[order]
        same = (ranked[1:] == ranked[:-1]).all(axis=1)
        hit = np.zeros(len(owner), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        hit &= np.array([r[5] for r in rows])[owner] == 1  # phrases that occur twice are settled
        at = np.flatnonzero(hit)
        if not len(at):
            return []
        cut = np.concatenate([[0], np.flatnonzero((np.diff(at) != 1) | (np.diff(owner[at]) != 0)) + 1, [len(at)]])
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            r = rows[owner[at[a]]]
            out.append((r[1], r[2], r[3] + int(i[at[a]]), r[3] + int(i[at[b - 1]]) + LENGTH))
        return out

    def emit(rows):
        found = settle_buckets(rows)
        cols = list(zip(*found, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["k1", "k2", "a", "b"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(held) >= BUCKET // 2 and row[0] != held[-1][0]:
                yield emit(held)
                held = []
            held.append(row)
    if held:
        yield emit(held)


def _by_halving(big: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    """Ranges of starts that repeat, for the phrases of large buckets.

    ``t`` - start is a string's offset from the trigger. The block of offsets p .. p + w - 1 has the
    core from t - p to t - p - w + 1 + LENGTH, part of each of its strings."""
    rows = big.select(
        "*", F.posexplode(F.array(F.lit(0), F.lit(128))).alias("__", "p")
    ).drop("__")
    found, width = None, 128
    while width:
        lo = F.greatest(F.lit(0), F.col("t") - F.col("p") - (width - 1))
        hi = F.least(F.col("m") - 1, F.col("t") - F.col("p"))
        core = F.substring(F.col("x"), F.col("t") - F.col("p") + 1, F.lit(LENGTH - width + 1))
        part = F.substring(F.col("x"), F.col("lo") + 1, F.col("hi") - F.col("lo") + LENGTH)
        state = (
            rows.withColumns({"lo": lo, "hi": hi})
            .filter("lo <= hi")
            .withColumns(
                {
                    "q1": F.xxhash64("h", "p", core),
                    "q2": F.xxhash64(F.lit(3), core, "h"),
                    "u1": F.xxhash64(F.col("t") - F.col("lo"), part),
                    "u2": F.xxhash64(part, F.lit(5)),
                }
            )
        )
        state = settle(state, "repeats-halves", scratch)
        cores = state.groupBy("q1", "q2").agg(
            F.min("u1").alias("u_lo"), F.max("u1").alias("u_hi"), F.count("*").alias("in_core")
        )
        parts = state.groupBy("q1", "q2", "u1", "u2").agg(F.count("*").alias("alike"))
        joined = state.join(parts, ["q1", "q2", "u1", "u2"]).join(cores.filter("in_core > 1"), ["q1", "q2"])
        hit = joined.filter("alike > 1 AND n = 1").select(
            "k1", "k2", (F.col("at") + F.col("lo")).alias("a"), (F.col("at") + F.col("hi") + LENGTH).alias("b")
        )
        found = hit if found is None else found.unionByName(hit)
        width //= 2
        if not width:
            break
        # a representative of parts that are alike stays, for others to meet
        open_rows = joined.filter("u_lo <> u_hi AND (alike = 1 OR n > 1)")
        keepers = (
            joined.filter("u_lo <> u_hi AND alike > 1 AND n = 1")
            .groupBy("q1", "q2", "u1", "u2")
            .agg(F.min(F.struct("k1", "k2", "h", "at", "m", "t", "x", "p")).alias("r"))
            .select("r.*", F.lit(2).cast("long").alias("n"))
        )
        names = ["k1", "k2", "h", "at", "m", "t", "x", "p", "n"]
        rows = (
            open_rows.select(*names)
            .unionByName(keepers.select(*names))
            .select(*[c for c in names if c != "p"], F.explode(F.array(F.col("p"), F.col("p") + width)).alias("p"))
        )
    return found


def _keys(docs: DataFrame, text_col: str) -> dict[str, Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)}


def spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(k1, k2, cut)`` for each distinct text with repeats: its byte ranges, packed as
    start * 2**32 + end, in no order and overlapping."""
    ship(docs.sparkSession)
    texts = docs.select(*(c.alias(n) for n, c in _keys(docs, text_col).items()), F.col(text_col).alias("text"))
    scratch: list[DataFrame] = []
    parse = settle(texts.mapInArrow(_parse, _ROWS), "repeats-parse", scratch)
    buckets = (
        parse.groupBy("h")
        .agg(F.count("*").alias("occurrences"), F.min("c").alias("lo"), F.max("c").alias("hi"))
        .filter("occurrences > 1")
    )
    # settled, so that the join of a hot trigger is a stage of its own whose partitions Spark may split
    shared = parse.join(settle(buckets, "repeats-buckets", scratch), "h")
    end = F.col("at") + F.col("m") + (LENGTH - 1)
    plain = shared.filter("lo = hi").select("k1", "k2", F.col("at").alias("a"), end.alias("b"))
    mixed = settle(shared.filter("lo <> hi").select("k1", "k2", "h", "c", "at", "m", "t"), "repeats-mixed", scratch)
    dictionary = mixed.groupBy("h", "c").agg(
        F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at", "m", "t")).alias("r")
    )
    dictionary = settle(dictionary.select("h", "c", "n", "r.*"), "repeats-dictionary", scratch)
    twice = (
        mixed.join(dictionary.filter("n > 1").select("h", "c"), ["h", "c"], "left_semi")
        .select("k1", "k2", F.col("at").alias("a"), end.alias("b"))
    )
    wanted = dictionary.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "c", "at", "m", "t", "n")).alias("want"))
    wanted = settle(wanted, "repeats-wanted", scratch)
    fetched = (
        texts.join(wanted, ["k1", "k2"])
        .select("k1", "k2", F.col("text").cast("binary").alias("raw"), F.explode("want").alias("w"))
        .select(
            "k1", "k2", "w.*",
            F.substring("raw", (F.col("w.at") + 1).cast("int"), F.col("w.m") + (LENGTH - 1)).alias("x"),
        )
        .dropDuplicates(["h", "c"])
    )
    sizes = settle(dictionary.groupBy("h").agg(F.count("*").alias("kinds")), "repeats-sizes", scratch)
    fetched = settle(fetched.join(sizes, "h"), "repeats-phrases", scratch)
    small = (
        fetched.filter(F.col("kinds") <= BUCKET)
        .select("h", "k1", "k2", "at", "m", "n", "x")
        .repartition("h")
        .sortWithinPartitions("h")
        .mapInArrow(_suffix_order, "k1 long, k2 long, a long, b long")
    )
    big = fetched.filter(F.col("kinds") > BUCKET).select("k1", "k2", "h", "at", "m", "t", "n", "x")
    ranges = plain.unionByName(twice).unionByName(small)
    if big.limit(1).count():
        ranges = ranges.unionByName(_by_halving(big, scratch))
    packed = (F.col("a") * F.lit(1 << 32).cast("long") + F.col("b")).alias("ab")
    cuts = settle(ranges.select("k1", "k2", packed).groupBy("k1", "k2").agg(F.collect_set("ab").alias("cut")), "repeats-cuts")
    discard(scratch)
    return cuts


def _merged(cut: list[int] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in sorted(cut or ()):
        a, b = x >> 32, x & 0xFFFFFFFF
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and, unless ``with_text`` is false, the
    kept text in ``text_col``. Characters cut in two by a span's edge go as a whole from that text;
    the hash is over the exact bytes. Columns of these names in ``docs`` are replaced."""
    ship(docs.sparkSession)
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    names = [c for c in docs.columns if with_text or c != text_col]
    cuts = spans(docs, text_col).withColumnsRenamed({"k1": "__k1", "k2": "__k2", "cut": "__cut"})
    keyed = docs.withColumns({f"__{n}": c for n, c in _keys(docs, text_col).items()})
    rows = keyed.join(cuts, ["__k1", "__k2"], "left").select(*docs.columns, "__cut")
    schema = docs.select(*names).schema
    for name, kind in zip(made, ("long", "long", "long", "string"), strict=True):
        schema = schema.add(name, kind)
    carried = rows.columns[:-1]
    place = carried.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            figures, kept_texts = [], []
            for text, cut in zip(batch.column(place), batch.column(batch.num_columns - 1), strict=True):
                raw = (text.as_py() or "").encode()
                parts, at, removed, n = [], 0, 0, 0
                for a, b in _merged(cut.as_py()):
                    parts.append(raw[at:a])
                    removed, n, at = removed + b - a, n + 1, b
                parts.append(raw[at:])
                kept = b"".join(parts)
                figures.append((len(raw), removed, n, hashlib.sha256(kept).hexdigest()))
                if with_text:
                    kept_texts.append("".join([p.decode(errors="ignore") for p in parts]) if text.is_valid else None)
            columns = {name: batch.column(i) for i, name in enumerate(carried)}
            if with_text:
                columns[text_col] = pa.array(kept_texts, pa.string())
            made_columns = [pa.array([f[i] for f in figures], pa.string() if i == 3 else pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([columns[n] for n in names] + made_columns, names + made)

    return rows.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return remove_repeats(docs.select("doc_id", "text"), with_text=False)
