import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserae.llm import repeats

L = 200


def brute(rows):
    raws = [(t or "").encode() for _, t in rows]
    count = Counter(r[i : i + L] for r in raws for i in range(len(r) - L + 1))
    out = []
    for (doc, _), r in zip(rows, raws, strict=True):
        spans = []
        for i in range(len(r) - L + 1):
            if count[r[i : i + L]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + L
                else:
                    spans.append([i, i + L])
        at, kept = 0, b""
        for a, b in spans:
            kept, at = kept + r[at:a], b
        kept += r[at:]
        out.append((doc, len(r), len(r) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(df, rows):
    got = [tuple(r) for r in repeats.digest(df).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_against_brute_force(docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [text(rng.randint(0, 40)) for _ in range(3)]
        passage = rng.choice(shared)
        cut = rng.randint(0, 60)
        rows.append((i, " ".join([parts[0], passage[cut : cut + rng.randint(150, 400)], parts[1], rng.choice(shared)[: rng.randint(0, 400)]])))
    rows += [(100, "z" * 900), (101, "ab" * 300), (102, rows[0][1]), (103, rows[1][1][:-3] + "!!!")]
    check(docs(rows), rows)


def test_large_buckets_are_halved(docs, monkeypatch):
    """Buckets over the bound are ordered by halving; the result is the same."""
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6))) for _ in range(n))
    core = text(30)
    rows = [(i, text(rng.randint(0, 30)) + core[: rng.randint(60, 150)] + text(30)) for i in range(40)]
    rows += [(50 + i, text(20) + core + text(rng.randint(0, 9)) + core[30:] + text(20)) for i in range(20)]
    monkeypatch.setattr(repeats, "BUCKET", 3)
    check(docs(rows), rows)


def test_odd_rows(docs, odd):
    got = {r.doc_id: r for r in repeats.digest(docs(odd)).collect()}
    assert repeats.digest(docs(odd)).count() == len(odd)
    assert got[1].n_bytes == 0 and got[1].n_spans == 0 and got[6].n_removed == got[6].n_bytes - 0 and got[7].n_spans == 1
    assert got[5].n_removed == 0


def test_empty_table_and_kept_text(docs):
    assert repeats.digest(docs([(1, "x")]).filter("doc_id < 0")).count() == 0
    passage = "é" * 150
    df = docs([(1, "left " + passage + " right"), (2, passage), (3, None)])
    got = {r.doc_id: r for r in repeats.remove_repeats(df.withColumn("n_bytes", F.lit("old"))).collect()}
    assert got[1].text == "left  right" and got[2].text == "" and got[3].text is None and got[1].lang == "en"


def test_long_texts_are_cut_into_slabs(docs, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(repeats, "SLAB", 4096)
    repeats._powers.cache_clear()
    import numpy as np
    import pyarrow as pa

    raw = "".join(rng.choice("abc ") for _ in range(9000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([raw])], ["a", "b", "text"])
    out = pa.Table.from_batches(list(repeats._parse(iter([batch])))).to_pylist()
    starts = sorted(x for r in out for x in range(r["at"], r["at"] + r["m"]))
    repeats._powers.cache_clear()
    assert starts == list(np.arange(len(raw) - L + 1))


@pytest.mark.parametrize("n", [0, 1, 199, 200, 201])
def test_short_texts(docs, n):
    rows = [(1, "q" * n), (2, "q" * n)]
    check(docs(rows), rows)
