import ast
import random
import zlib
from collections import Counter
from pathlib import Path

import pytest

from tesserae.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(1, 12))]
        toxic = rng.random() < 0.3
        if toxic:
            k = rng.randrange(len(parts))
            parts[k] += " " + rng.choice(["idiot", "moron", "scum"]) + rng.choice(["", "s", "ish", "like"])
        rows.append((i, ". ".join(parts), int(toxic)))
    return rows


def test_held_out_accuracy_and_sentences(spark, docs):
    rows = corpus(900, 1)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    df = docs([(i, t) for i, t, _ in rows])
    got = {r.doc_id: r for r in toxicity.digest(df, labels).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert sum(got[i].predicted == y for i, y in held) / len(held) > 0.95
    model = toxicity.train(df, labels)
    found = toxicity.offending(df, model).collect()
    bad = [r for r in found if any(w in r.sentence for w in ("idiot", "moron", "scum"))]
    assert len(bad) > 200 and len(bad) >= 0.95 * len(found)


def test_odd_rows_and_missing_labels(spark, docs, odd):
    df = docs(odd)
    for labels in ([], [(4, 1, 0), (5, 0, 0)], [(4, 1, 1), (4, 1, 0), (5, 1, None), (None, 1, 1)]):
        told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        got = toxicity.digest(df, told).collect()
        assert len(got) == len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert toxicity.digest(df.filter("doc_id < 0"), told).count() == 0


@pytest.mark.parametrize("scores", [[], [0.0], [0.2, 0.5], [1.0, 0.3]])
def test_noisy_or(scores):
    rest = 1.0
    for s in scores:
        rest *= 1 - s
    assert abs(toxicity.noisy_or(scores) - (1 - rest)) < 1e-9


def test_each_function_stands_once():
    body = ast.parse(Path(toxicity.__file__).read_text()).body
    assert max(Counter(n.name for n in body if isinstance(n, ast.FunctionDef)).values()) == 1


def test_sample_counts_copies_once_and_only_documents(spark, docs, monkeypatch):
    monkeypatch.setattr(toxicity, "POSITIVES", 3)
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: (texts, y))
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, "copy" if n < 20 else f"text {i}") for n, i in enumerate(ids[:24])]
    labels = spark.createDataFrame([(i, 1, 1) for i in ids], "doc_id long, quality int, toxic int")
    texts, y = toxicity.train(docs(rows), labels)
    assert len(set(texts)) == len(texts) == 3 and y == [1, 1, 1]
