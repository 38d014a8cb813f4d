import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tesserae.llm import privacy
from tesserae.runtime import sized_broadcast


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
]


def brute(text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(RULES) for m in re.finditer(p, text or "") if ok(m[0]))
    told = ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in found)
    return (*(sum(k == i for _, k, _ in found) for i in range(4)), hashlib.sha256(told.encode()).hexdigest())


TRICKY = [
    "a@b.com_x@d.ef", "a@b.c@d.e", "x" * 5000 + "@", "q.w+e%r@t-y.u.i..o", "1.2.3.4.5.6.7.8", "001.2.3.255 256.1.1.1 1.1.1.0300",
    "4111 1111 1111 1111", "4111-1111  1111 1111", "4111111111111112", "1 " * 30_000, "+1 (979) 555-6697.", "+1 23", "++12345678901",
    "+1" + "-" * 5000, "é\U0001f600 a@b.co 你 1.2.3.4", "a@b" + ".c" * 20_000, "٣.٣.٣.٣ a@é.com", "-" * 50_000, "@@@a@b.c", "12" * 10,
]


def test_base_against_brute_force(docs, odd):
    rng = random.Random(3)
    rows = [*odd, *((50 + i, t) for i, t in enumerate(TRICKY))]
    rows += [(100 + i, "".join(rng.choice("a1.@+- ()_%4é") for _ in range(rng.randint(0, 80)))) for i in range(400)]
    rows += [(600 + i, "".join(rng.choice("0123456789 -") for _ in range(rng.randint(10, 60)))) for i in range(300)]
    got = privacy.digest(docs(rows)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert privacy.digest(docs(rows).filter("doc_id < 0")).count() == 0


WORD = re.compile(r"[^\W_]+")


def term_rule(rows):
    """Disclosing terms (words, or pairs of words) of (id, text) rows, in plain Python."""
    texts = {t or "" for _, t in rows}

    def entities(t):
        for m, k in ((m, k) for k, (_, p, ok) in enumerate(RULES) for m in re.finditer(p, t) if ok(m[0])):
            yield m.span(), (k, m[0].lower() if k == 0 else ".".join(str(int(x)) for x in m[0].split(".")) if k == 1 else digits(m[0]))

    def terms(words):
        for i, w in enumerate(words):
            yield (w,), i, i
            if i:
                yield (words[i - 1], w), i - 1, i

    with_e, contexts, n_t = defaultdict(set), defaultdict(set), Counter()
    for t in texts:
        n_t.update({x for x, _, _ in terms([w.lower() for w in WORD.findall(t)])})
        found = sorted(entities(t))
        blank, at = "", 0
        for (a, b), _ in found:
            blank += t[at:a] + "\n" if a >= at else ""
            at = max(at, b)
        words = [w.lower() for w in WORD.findall(blank + t[at:])]
        for e in {e for _, e in found}:
            with_e[e].add(t)
            first = {}
            for x, i, j in terms(words):
                first.setdefault(x, (tuple(words[max(0, i - 3) : i]), tuple(words[j + 1 : j + 4])))
            for x, c in first.items():
                contexts[e, x].add(c)
    out = set()
    for (e, x), c in contexts.items():
        p, whole = len(c) / (n_t[x] + 2), math.log2(len(texts) / len(with_e[e]))
        if len(with_e[e]) > 1 and len(c) > 1 and whole > 0 and p >= 0.5 and math.log2(p * len(texts) / len(with_e[e])) >= 0.75 * whole:
            out.add(x)
    return out


def term_spans(text, telling):
    found = [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text or "")]
    out = []
    for i, (w, a, b) in enumerate(found):
        if (w,) in telling:
            out.append(f"term:{a}:{b}")
        elif i and (found[i - 1][0],) not in telling and (found[i - 1][0], w) in telling:
            out.append(f"term:{found[i - 1][1]}:{b}")
    return sorted(out)


def test_term_rule_against_a_plain_model(docs, odd, monkeypatch):
    rng = random.Random(9)
    rare = {0: ["zanzibar", "Quorra"], 1: ["obelisk"], 2: ["mei lin"], 3: []}
    mails = {0: "Boss@acme.com", 1: "10.0.0.7", 2: "+1 (979) 555-6697", 3: "4111 1111 1111 1111"}
    rows = list(odd)
    for i in range(300):
        words = [rng.choice(["note", "from", "the", "office", "mei", "lin", "of", "today", "3"]) for _ in range(rng.randint(3, 30))]
        k = rng.randrange(20)
        if k in mails:
            for extra in [rng.choice([mails[k], mails[k].lower()]), *rare[k]]:
                words.insert(rng.randint(0, len(words)), extra)
        elif k == 19:
            words.insert(1, "ZANZIBAR")
        rows.append((1000 + i, " ".join(words)))
    telling = term_rule(rows)
    assert {("zanzibar",), ("quorra",), ("obelisk",)} <= telling and ("note",) not in telling
    for bound in (200_000, 0):  # candidates by broadcast and by shuffle
        monkeypatch.setattr(privacy, "sized_broadcast", lambda df, most=bound: sized_broadcast(df, min(most, bound)))
        got = privacy.digest(docs(rows)).collect()
        assert sorted(((r.doc_id, sorted(x for x in r.spans.split(",") if x[:4] == "term")) for r in got), key=str) == sorted(
            ((i, term_spans(t, telling)) for i, t in rows), key=str
        )


def test_terms_go_wherever_they_stand(docs):
    rows = [(i, f"note {i} from zanzibar office write to boss@acme.com today please {i}") for i in range(6)]
    rows += [(100 + i, f"note from today office please write {i}") for i in range(200)]
    rows += [(400, "a note from Zanzibar today")]
    got = {r.doc_id: r.spans for r in privacy.digest(docs(rows)).collect()}
    text = rows[0][1]
    a, e = text.index("zanzibar"), text.index("boss@")
    assert got[0].split(",")[0] == f"term:{a}:{a + 8}" and f"email:{e}:{e + 13}" in got[0].split(",")
    assert got[100] == "" and got[400] == "term:12:20"
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs(rows)).collect()}
    assert clean[0].startswith("note 0 from [TERM] ") and "zanzibar" not in clean[0] and "[EMAIL]" in clean[0] and clean[100] == rows[6][1]
    assert clean[400] == "a note from [TERM] today"


def test_many_matches_in_one_text(docs):
    text = " ".join(f"x{i}@d{i}.org, 10.1.{i % 250}.9;" for i in range(8000))
    df = docs([(1, text)])
    row = privacy.digest(df).first()
    assert (row.doc_id, row.n_email, row.n_ip, row.base_sha256) == (1, 8000, 8000, brute(text)[-1])
    assert privacy.sanitise(df).first().text == " ".join(["[EMAIL], [IP];"] * 8000)


def test_copies_alone_disclose_nothing(docs):
    rows = [(i, "call zanzibar at a@b.com") for i in range(9)] + [(50, None), (51, "")]
    df = docs(rows)
    assert all("term" not in r.spans for r in privacy.digest(df).collect())
    out = privacy.sanitise(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert {r.text for r in out.collect()} == {"call zanzibar at [EMAIL]", None, ""}


@pytest.mark.parametrize("text", ["plain", "1.2.3.4", "a@b.co +1 234 567 8901"])
def test_no_python_in_the_plan(docs, text):
    plan = privacy.digest(docs([(1, text)]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
