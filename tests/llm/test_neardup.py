import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tesserae.llm import neardup, simhash


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The smallest id of each component of pairs with Jaccard >= 0.8."""
    sets, parent = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    return sorted(min(g) for g in groups.values())


def families(rng, n, size):
    rows = []
    for f in range(n):
        base = [f"f{f}w{j}" for j in range(150)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = f"c{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(t)))
    return rows


@pytest.mark.parametrize("cap", [128, 4])
def test_against_brute_force(docs, cap):
    """Small blocks by pairs, crowded ones by hubs and what they leave over."""
    rows = families(random.Random(4), 6, 25)
    got = sorted(r.doc_id for r in neardup.one_of_each(docs(rows, extra=False), block_cap=cap).collect())
    assert got == brute(rows)


def test_stage_finds_more_than_two_bits(docs):
    base = [f"w{j}" for j in range(120)]
    other = list(base)
    other[30] = other[80] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(f"v{j}" for j in range(120)))]
    prints = [simhash.text_fingerprint(t) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() > 2
    got = corpus_pipeline.near_dedup(None, docs(rows, extra=False), "")
    assert {r.doc_id for r in got.collect()} == {1, 3}


def test_odd_rows(docs, odd):
    df = docs(odd, extra=False)
    got = neardup.one_of_each(df).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted([1, 4, 5, None, 6, 7, 8, 9], key=str)
    assert neardup.one_of_each(df.filter("doc_id < 0")).count() == 0


def test_chained_on_repeated_rows_and_copies_without_an_id(spark, docs):
    body = lambda k: " ".join(f"w{k}x{j}" for j in range(80))
    rows = [(1, body(1)), (1, body(1)), (2, body(2)), (None, body(2)), (None, body(3)), (None, body(3)), (4, body(4) + " a"), (4, body(4) + " b")]
    now = docs(rows, extra=False)
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.repeated_passages):
        now = spark.createDataFrame(stage(spark, now, "").collect(), now.schema)
    got = {(r.doc_id, r.text) for r in now.collect()}
    assert now.count() == 4 and {i for i, _ in got} == {1, 2, None, 4}
    assert {(1, body(1)), (2, body(2)), (None, body(3))} < got and dict(got)[4] in (body(4) + " a", body(4) + " b")


def test_chunks_against_sets():
    rng = random.Random(3)
    sets = [[neardup.shingles(t) for _, t in families(rng, 2, 12)] + [neardup.shingles("")] for _ in range(2)]
    got = neardup.similar_in_chunks(*sets)
    for i, a in enumerate(sets[0]):
        for j, b in enumerate(sets[1]):
            assert got[i, j] == neardup.similar(a, b)


def test_segments_of_the_simhash_bring_pairs_of_0_8_together():
    """Keys are runs of the majority bits; pairs of exactly 0.8 agree in one and pass the ring, unlike ones do not pass it."""
    rng = np.random.default_rng(1)
    width, segments = neardup.segments_for(1000)
    one = lambda x: neardup.fingerprint(np.sort(x), width * segments)
    mark = lambda x, bits: np.array([[len(x), *np.packbits(bits[: neardup.BITS]).view(np.uint64)]], np.uint64)
    for _ in range(200):
        shared, *extra = (rng.integers(0, 1 << 64, n, np.uint64) for n in (240, 30, 30, 270))
        a, b, c = np.append(shared, extra[0]), np.append(shared, extra[1]), extra[2]
        bits = [one(x) for x in (a, b, c)]
        keys = [neardup.segment_keys(x, width) for x in bits]
        agree = [(bits[0][i : i + width] == bits[1][i : i + width]).all() for i in range(0, width * segments, width)]
        assert [x == y for x, y in zip(*keys[:2], strict=True)] == agree and any(agree)
        assert neardup.close(mark(a, bits[0]), mark(b, bits[1])).all() and not neardup.close(mark(a, bits[0]), mark(c, bits[2])).any()


@pytest.mark.parametrize("cap", [128, 4])
def test_blocks_over_the_limit_against_brute_force(docs, cap):
    """Blocks hung on a hub, the rows far from it in tiles and blocks of their own."""
    rows = families(random.Random(6), 6, 25)
    got = sorted(r.doc_id for r in neardup.one_of_each(docs(rows, extra=False), block_cap=cap, block_most=4).collect())
    assert got == brute(rows)


def test_crowds_pass_the_ring_first():
    """Rows of a crowd are linked by their shingles only where their fingerprints are close."""
    text = " ".join(f"w{j}" for j in range(40))

    def links(words):
        rows = [(1, 0, 0, 0, 11, 36, 0, 0, 0, text), (1, 0, 0, 1, 12, 36, *words, text)]
        cols = [pa.array(c) for c in zip(*rows, strict=True)]
        batch = pa.RecordBatch.from_arrays(cols, ["crowd", "l", "o", "side", "node", "size", "f1", "f2", "f3", "t"])
        return [tuple(r.values()) for out in neardup._compare(iter([batch])) for r in out.to_pylist()]

    assert links((0, 0, 0)) == [(12, 11)] and links((-1, -1, -1)) == []


def test_pairs_of_a_crowd_are_never_rows(docs, monkeypatch):
    """160 near copies make 12,720 pairs; the candidates that are written stay in proportion to the copies."""
    rng, rows, made, real = random.Random(8), [], {}, neardup.settle
    for k in range(160):
        t = [f"w{j}" for j in range(150)]
        for _ in range(rng.randint(1, 3)):
            t[rng.randrange(len(t))] = f"c{rng.randrange(10**9)}"
        rows.append((k, " ".join(t)))

    def settle(df, name, *rest):
        out = real(df, name, *rest)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(neardup, "settle", settle)
    got = sorted(r.doc_id for r in neardup.one_of_each(docs(rows, extra=False), block_cap=32).collect())
    assert got == brute(rows)
    assert {"neardup-near", "neardup-pairs"} <= set(made) and max(made["neardup-near"], made["neardup-pairs"]) <= 25 * len(rows), made
