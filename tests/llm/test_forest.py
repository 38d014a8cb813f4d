import math

import numpy as np
import pytest

from tesserae.llm import forest


def brute(rows, threshold=0.95):
    good = [i for i, (_, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            i, j = good[a], good[b]
            x, y = np.array(rows[i][1], np.float64), np.array(rows[j][1], np.float64)
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold - 1e-12:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, links[i], least[find(i)], k == least[find(i)]) for i, (k, _) in enumerate(rows))


def made(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, cid string").repartition(3)


def near_rows(n=300, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 3, 16))
    rows = []
    for i in range(n):
        v = base[i % len(base)] + rng.standard_normal(16) * (0.05 if i % 2 else 0.16) * (i >= len(base))
        rows.append((i, [float(np.float32(x)) for x in v]))
    return rows


def test_against_brute_force(spark):
    rows = near_rows()
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [float("inf")] + [1.0] * 15), (2005, []), (2006, [1.0, 2.0])]
    got = sorted(map(tuple, forest.digest(made(spark, rows)).collect()))
    assert got == brute(rows)


@pytest.mark.parametrize("cap", [16, 4096])
def test_recall_with_deep_trees_and_blocks(spark, monkeypatch, cap):
    monkeypatch.setattr(forest, "LEAF_CAP", cap)
    rows = near_rows(600, 2)
    out = forest.near_duplicates(made(spark, rows), leaf=16).collect()
    want = {r[0]: r for r in brute(rows)}
    assert all(r.n_links <= want[r.id][1] for r in out)
    assert sum(r.n_links for r in out) >= 0.98 * sum(r[1] for r in want.values())


def test_group_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAF_CAP", 64)
    monkeypatch.setattr(forest, "STEP", 16)
    rng = np.random.default_rng(4)
    core = rng.standard_normal(16)
    rows = [(i, [float(np.float32(x)) for x in core + rng.standard_normal(16) * 0.12]) for i in range(400)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(5000)] + [(None, rows[0][1]), (None, None), (None, [5.0] * 15 + [-9.0])]
    got = {r.vec_id: r for r in forest.digest(made(spark, rows)).collect() if r.vec_id is not None}
    want = brute([r for r in rows[:400]])
    unit = np.array([r[1] for r in rows[:400]])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    times = np.ones(400, int)
    for i in range(5000):
        times[i % 7] += 1
    times[0] += 1
    near = unit @ unit.T >= 0.95
    for i in range(400):
        assert got[i].n_links == (near[i] * times).sum() - 1, i
        assert got[i].component_id == want[i][2]


def test_labels_of_a_long_chain():
    n = 300
    turn = np.linspace(0, 1.5, n)
    unit = np.stack([np.cos(turn), np.sin(turn)], axis=1)
    cid = np.random.default_rng(1).permutation(n)
    least = math.cos(turn[1]) - 1e-9  # a link to the next one only
    none = np.zeros(0, np.int64)
    for second in (None, np.arange(n) % 2 == 1):
        found = forest.compare_leaf(0, cid, unit, np.ones(n, np.int64), none, np.zeros(n, np.int64), second, least)
        assert len(forest.compare_leaf(0, cid, unit, np.ones(n, np.int64), none, np.zeros(n, np.int64), np.zeros(n, bool), least)[0]) == 0
        assert len(found[0]) == n and set(found[2]) == {0} and sorted(found[1]) == [1, 1] + [2] * (n - 2)


def test_deep_forest_keeps_its_thresholds_small_and_its_recall(monkeypatch):
    """14 levels over 60,000 vectors with planted pairs at the threshold and above."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine = rng.uniform(0.95, 0.99, 3000)
    side = rng.standard_normal((3000, 64))
    side -= (side * x[:3000]).sum(axis=1, keepdims=True) * x[:3000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    pairs = cosine[:, None] * x[:3000] + np.sqrt(1 - cosine**2)[:, None] * side
    width = 0.25 * math.sqrt(0.1) / 8
    trees = forest.Forest(x[: forest.SAMPLE], 64, 14, forest.TREES, width)
    assert max(len(c) for t in trees.cuts for c in t) <= 1 << forest.FITTED
    homes = []
    for rows in (x[:3000], pairs):
        row, leaf = trees.leaves(rows)
        homes.append([set(h.tolist()) for h in np.split(leaf, np.searchsorted(row, np.arange(1, 3000)))])
    recall = sum(bool(a & b) for a, b in zip(*homes, strict=True)) / 3000
    copies = sum(map(len, homes[0])) / 3000 / forest.TREES
    row, leaf = trees.leaves(x)
    assert recall >= 0.97 and copies < 3 and np.bincount(leaf).max() < 60


def test_empty(spark):
    assert forest.digest(made(spark, [(1, [1.0])]).filter("vec_id < 0")).count() == 0
