import random
import re
from collections import defaultdict

import duckdb
import pytest

from tesserae.llm import quality
from tesserae.llm import queries as Q

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    where = defaultdict(list)
    for i in range(len(words) - 2):
        where[tuple(words[i : i + 3])].append(i)
    covered = {i + j for at in where.values() if len(at) > 1 for i in at for j in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed
    )


def test_statistics_against_a_plain_model(docs, odd, monkeypatch):
    rng = random.Random(1)
    rows = list(odd)
    for i in range(120):
        words = [rng.choice(["a", "b", "c", "d#", "é", "$x|"]) for _ in range(rng.randint(0, 200))]
        rows.append((100 + i, "".join(w + rng.choice([" ", "  ", "\n", "\t", " \n "]) for w in words)))
    want = sorted(((i, *base(t)) for i, t in rows), key=str)
    for few in (0, 24):
        monkeypatch.setattr(quality, "FEW", few)
        got = quality.digest(docs(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert sorted(map(tuple, got.collect()), key=str) == want


def unique(i, n=60):
    return " ".join(f"w{i}x{j}" for j in range(n))


def rule(rows, min_docs=10, share=0.01):
    """Kept ids and cleaned texts of (id, text, host) rows, in plain Python."""
    norm = lambda x: " ".join(w for w in SPACE.split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)) if w)
    held, hosts = defaultdict(set), defaultdict(set)
    for _, t, host in rows:
        lines = [norm(x) for x in (t or "").split("\n") if norm(x)]
        if lines:
            hosts[host].add(tuple(lines))
        for x in lines:
            held[host, x].add(tuple(lines))
    over = {k for k, docs in held.items() if len(docs) > min_docs and len(docs) > share * len(hosts[k[0]])}
    out = []
    for i, t, host in rows:
        lines = (t or "").split("\n")
        lost = sum(len(norm(x).split(" ")) for x in lines if (host, norm(x)) in over)
        if not base(t)[-1] and lost * 2 <= base(t)[0]:
            out.append((i, "\n".join(x for x in lines if (host, norm(x)) not in over)))
    return out


def test_line_frequency_against_a_plain_model(spark):
    menu = [f"Menu{j}  entry{j} of{j} site{j}" for j in range(20)]
    rows = [(i, "\n".join([*menu, unique(i)]), "menus") for i in range(25)]  # menus of many lines
    rows += [(50 + i, "\n".join([*menu, unique(50 + i, 200)]), "long") for i in range(25)]
    rows += [(100 + i, unique(100), "copies") for i in range(30)]
    rows += [(150 + i, unique(150 + i), "clean") for i in range(30)]
    rows += [(200 + i, unique(200) if i % 2 else unique(200).upper() + f"\n x{i}", "one line") for i in range(30)]
    rows += [(300 + i, "\n".join([unique(300 + i), " SHARED  line\tof null ", "", ""]), None) for i in range(12)]
    rows += [(400 + i, unique(400 + i) + "\nat the limit", "ties") for i in range(10)]
    rows += [(500, "\n".join([*menu, unique(1, 90)]), "rare here"), (501, None, "menus"), (502, "", None), (None, unique(7), None), (None, unique(7), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want = rule(rows)
    got = quality.keep(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert sorted((r.doc_id for r in quality.digest(df).filter("kept").collect()), key=str) == sorted((i for i, _ in want), key=str)
    kept = {i for i, _ in want}
    assert not kept & set(range(25)) and kept >= {*range(50, 75), *range(100, 130), *range(150, 180), *range(300, 312), 500}
    assert all("Menu" not in t for i, t in want if i != 500) and all("limit" in t for i, t in want if i in range(400, 410))


def test_no_python_in_the_plan(docs):
    for made in (quality.digest, quality.keep):
        plan = made(docs([(1, "a b c")]))._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(docs):
    assert quality.digest(docs([(1, "x")]).filter("doc_id < 0")).count() == 0


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_queries_equal_their_sql(spark, small, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    mine = Q.queries()[name](spark, small)
    theirs = c.sql(Q.oracle_sql()[name])
    cols = sorted(mine.columns)
    assert cols == sorted(theirs.columns)
    quoted = ", ".join(f'"{x}"' for x in cols)
    assert sorted(map(str, map(tuple, mine.select(cols).collect()))) == sorted(map(str, theirs.project(quoted).fetchall()))
