import random
from datetime import datetime, timedelta

from tesserae.operators.asof import asof_join

START = datetime(2024, 3, 1)


def test_against_brute_force(spark):
    rng = random.Random(4)
    at = lambda: None if rng.random() < 0.05 else START + timedelta(seconds=rng.randrange(20_000))
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(n, key(), at()) for n in range(300)]
    right = [(key(), at(), rng.randrange(5)) for _ in range(150)] + [("hot", START, 1), ("hot", START, 3)]
    lf = spark.createDataFrame(left + left[:3], "n int, k string, t timestamp")
    rf = spark.createDataFrame(right, "k string, t timestamp, v int")
    for width in (60.0, 3000.0, 1e9):
        got = sorted((r.n, r.matched and tuple(r.matched)) for r in asof_join(lf, rf, ["k"], "t", width=width).collect())
        want = []
        for n, k, t in left + left[:3]:
            fit = [(rt, v) for rk, rt, v in right if None not in (k, t, rt) and rk == k and rt <= t]
            want.append((n, max(fit) if fit else None))
        assert got == sorted(want, key=lambda x: x[0]) or sorted(got, key=str) == sorted(want, key=str)


def test_empty_sides(spark):
    some = spark.createDataFrame([("a", 1)], "k string, t int")
    none = some.limit(0)
    assert [r.matched for r in asof_join(some, none, ["k"], "t").collect()] == [None]
    assert asof_join(none, some, ["k"], "t").count() == 0
