import random

import xxhash

from tesserae.llm import simhash
from tesserae.llm.components import components


def model(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [(k, f"{p:016x}", least.get(find(i))) for i, (k, p) in enumerate(prints)]


def test_digest_against_brute_force(docs, odd):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(20)]
    rows = list(odd)
    for i in range(80):
        t = texts[i % 20].split()
        if i >= 20:
            t[rng.randrange(len(t))] = "changed"
        rows.append((100 + i, " ".join(t)))
    got = sorted(map(tuple, simhash.digest(docs(rows)).collect()), key=str)
    assert got == sorted(brute([(i, model(t)) for i, t in rows]), key=str)
    assert simhash.digest(docs(rows).filter("doc_id < 0")).count() == 0


def test_links_of_random_and_crowded_prints(spark):
    """Blocks within the cap by pairs, blocks over it by variants: the same components."""
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (2**64 - 1) for b in base for _ in range(60)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = {}
    for k, _, least in brute([(s, s & (2**64 - 1)) for s in sorted(signed)]):
        want[k] = least
    for cap in (4, 1000):
        found = {r.node: r.component for r in components(simhash.links(df, block_cap=cap), "a", "b").collect()}
        assert {p: found.get(p, p) for p in signed} == want
    for segments in (3, 7):
        found = {r.node: r.component for r in components(simhash.links(df, segments=segments), "a", "b").collect()}
        assert {p: found.get(p, p) for p in signed} == want


def test_components_of_a_path_and_of_nothing(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
    assert {r.component for r in components(path, "a", "b").collect()} == {0}
    assert components(path.filter("a < 0"), "a", "b").count() == 0
