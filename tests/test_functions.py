import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions import similarity as S
from tesserae.functions import text as T
from tesserae.sources.formats import detect_format


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [("$20,406.25", 20406.25), ("(83)", -83.0), ("64%", 64.0), ("€ 9", 9.0), ("0", 0.0), ("tide", None), ("QX-0093", None), ("", None), (None, None)],
)
def test_parse_number(spark, raw, wanted):
    assert value(spark, T.parse_number, raw) == wanted


def test_tokens(spark):
    got = value(spark, T.tokens, "The waybill WB-2031-0644 weighs 27,310.50 in cargo_crates of windSpeed")
    assert {"wb-2031-0644", "0644", "27310.50", "27310", "cargo_crates", "crate", "wind"} <= set(got)
    assert "the" not in got


def test_numbers(spark):
    got = set(value(spark, T.numbers, "EUR 73.4 million, 6%, $3,020,000 [S2]"))
    assert got >= {"73.4", "73400000", "6", "3020000"}
    assert "2" not in value(spark, T.numbers, "see [S2]")


def test_split_claims_keeps_citations_with_sentences(spark):
    text = "Cargo was 73.4 million. [S1] Pilots were 268 [S2].\n- Cranes stop in November [S3]\n| p | q |\n|---|---|"
    assert value(spark, T.split_claims, text) == [
        "Cargo was 73.4 million. [S1]", "Pilots were 268 [S2].", "Cranes stop in November [S3]", "| p | q |",
    ]


def test_citations(spark):
    assert value(spark, T.cited_ids, "a [S3], b [S1, S2] c [1;2]") == [3, 1, 2, 1, 2]
    assert value(spark, T.strip_citations, "Yes [S1]. No [2] !") == "Yes. No!"


def test_small_text_functions(spark):
    assert value(spark, T.estimate_tokens, "x" * 33) == 11
    assert value(spark, T.estimate_tokens, "") == 1
    assert value(spark, T.is_not_found, "**NOT_FOUND**") and not value(spark, T.is_not_found, "It was found [S1].")
    assert value(spark, T.is_total_label, "Grand total") and not value(spark, T.is_total_label, "Totally")
    assert value(spark, T.extract_json, '<think>x</think>```json\n{"a": [1]}\n``` done') == '{"a": [1]}'
    assert value(spark, T.numbered, "a\nb") == "   1 | a\n   2 | b"
    assert value(spark, T.safe_filename, "../x/con.txt") == "_con.txt"
    assert value(spark, lambda c: T.is_followup(c, F.lit(1)), "What about the second one of them in the list?")
    assert not value(spark, lambda c: T.is_followup(c, F.lit(0)), "and it?")


def test_formats(spark):
    names = ["a/b.PDF", "x.md", "y.tar.ts", "z.xlsx", "noext", ".md", "p.jpeg"]
    got = [value(spark, detect_format, n) for n in names]
    assert got == ["pdf", "markdown", "code", "tabular", None, None, "image"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def test_indel_ratio_against_a_plain_model():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert S.lcs_length(a, b) == lcs(a, b)
    assert S.ratio("", "") == 100 and S.partial_ratio("abc", "xxabcxx") == 100
    assert S.token_set_ratio("fuzzy was a bear", "a bear fuzzy was fuzzy") == 100


def test_best_quote_prefers_sentence_with_number():
    src = "The log covers 2031. Pilots were 268 at the close. Piers are in four harbours."
    assert S.best_quote("268 men", src) == "Pilots were 268 at the close."
