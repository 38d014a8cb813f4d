import pytest

from tesserae.operators import evidence as E

SOURCES = [
    (1, "Total cargo reached 73.4 million tonnes in 2031, up 6% from 2030."),
    (2, "When the season closed the port employed 268 pilots across four piers."),
    (3, "Harbour cranes are stopped from November 11 to February 3."),
]
HANDBOOK = [
    (1, "Watches change on Tuesdays at 09:30 UTC. Alarms must be answered within 12 minutes. Landings are not allowed on Sundays.")
]


def check(spark, answer, sources=SOURCES):
    a = spark.createDataFrame([(1, answer)], "qid long, answer string")
    s = spark.createDataFrame([(1, n, c) for n, c in sources], "qid long, s int, content string")
    return E.verify(a, s).orderBy("place").collect()


def test_supported_claims(spark):
    got = check(spark, "Total cargo was 73.4 million tonnes in 2031 [S1]. The port employed 268 pilots [S2].")
    assert [r.label for r in got] == ["supported", "supported"]


def test_wrong_number_is_unsupported_and_removed(spark):
    draft = "Cargo was 91.7 million tonnes [S1]. The port employed 268 pilots [S2]."
    got = check(spark, draft)
    assert got[0].label == "unsupported" and "91.7" in got[0].reason
    left = E.remove_unsupported(draft, [r.claim for r in got if r.label == "unsupported"])
    assert "91.7" not in left and "268" in left


def test_citation_repair(spark):
    [r] = check(spark, "The port employed 268 pilots [S1].")
    assert r.label == "supported" and r.citations == [2]
    [r] = check(spark, "Harbour cranes are stopped from November 11 to February 3.")
    assert r.label == "supported" and r.citations == [3]


@pytest.mark.parametrize("claim", ["Alarms must be answered within one day [S1].", "Alarms must never be answered within 12 minutes [S1].", "Landings are allowed on Sundays [S1]."])
def test_contradictions_are_never_supported(spark, claim):
    assert check(spark, claim, HANDBOOK)[0].label != "supported"


@pytest.mark.parametrize("claim", ["Alarms must be answered within 12 minutes [S1].", "Landings are not allowed on Sundays [S1]."])
def test_agreement_is_supported(spark, claim):
    assert check(spark, claim, HANDBOOK)[0].label == "supported"


def test_renumber():
    text, order = E.renumber_text("Idle cranes [S3]. Pilots 268 [S2][S9]. Both [S3, S2].", 3)
    assert text == "Idle cranes [1]. Pilots 268 [2]. Both [1][2]." and order == [3, 2]


def test_confidence(spark):
    rows = [(1, "a b c d 1", [1], "supported", ""), (2, "a b c d 1", [1], "supported", ""), (2, "x y z w 99", [1], "unsupported", "number(s) 99 not found")]
    v = spark.createDataFrame(rows, "qid long, claim string, citations array<int>, label string, reason string")
    c = spark.createDataFrame([(1, "retrieval", 0.9), (2, "retrieval", 0.9)], "qid long, agent string, score double")
    got = {r.qid: r for r in E.confidence(v, c).collect()}
    assert got[1].band == "high" and got[1].score > 0.9 and got[2].score <= 0.5


def test_selection_budget_and_specialists_first():
    item = lambda i, text, agent, score: {"id": f"e{i}", "agent": agent, "content": text, "score": score, "doc_id": "d1"}
    items = [item(i, f"passage {i} {chr(97 + i) * 40} " * 12, "retrieval", 0.5 + i / 100) for i in range(10)]
    chosen = E.select_within([*items, item(99, "RESULT: total = 5", "table", 1.0)], 400)
    assert chosen[0]["agent"] == "table" and sum(len(e["content"]) for e in chosen) / 3.2 <= 400 + 60 * len(chosen)


def test_merge_keeps_the_higher_score_and_the_earlier_on_ties(spark):
    a = spark.createDataFrame([("x", 1.0, "a"), ("y", 1.0, "a")], "id string, score double, src string")
    b = spark.createDataFrame([("x", 1.0, "b"), ("y", 2.0, "b")], "id string, score double, src string")
    assert {(r.id, r.src) for r in E.merge([a, b]).collect()} == {("x", "a"), ("y", "b")}
