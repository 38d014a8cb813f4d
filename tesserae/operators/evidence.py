"""Evidence: merging, budgeted selection, claim checks, citation repair and numbering, confidence.

Rows are keyed by question, so a batch of questions is one plan. Claims meet their cited sources by
equi-join. Two steps are folds over one question's bounded list (selection within a token budget,
numbering citations in one answer) and run per question in Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import similarity as S
from tesserae.functions import text as T

MOST_SOURCES, PER_SUBQUERY, SAME_RATIO, SAME_CHARS = 12, 3, 92.0, 400
COVERAGE, COVERAGE_NUMERIC, REPAIR_RATIO = 0.9, 0.75, 70.0
WEIGHTS = {"verified": 0.45, "retrieval": 0.20, "coverage": 0.20, "numeric": 0.15}
SPECIALISTS = ("table", "code", "vision")


def merge(branches: list[DataFrame], key: str = "id", by: str = "score", within: tuple[str, ...] = ()) -> DataFrame:
    """Union by id; the higher score wins, on ties the earlier branch."""
    rows = branches[0].withColumn("__branch", F.lit(0))
    for i, b in enumerate(branches[1:], 1):
        rows = rows.unionByName(b.withColumn("__branch", F.lit(i)))
    order = Window.partitionBy(*within, key).orderBy(F.col(by).desc_nulls_last(), "__branch")
    return rows.withColumn("__place", F.row_number().over(order)).filter("__place = 1").drop("__place", "__branch")


def from_hits(hits: DataFrame) -> DataFrame:
    """Search hits with their chunk columns as evidence rows."""
    return hits.select(
        "qid",
        F.col("chunk_id").alias("id"),
        F.lit("retrieval").alias("agent"),
        "kind",
        F.col("text").alias("content"),
        "score",
        "doc_id",
        "file_name",
        T.location("page_start", "page_end", "page_approx", "file_type", "line_start", "line_end", "sheet").alias("location"),
    ).withColumn("label", F.concat_ws(" · ", "file_name", F.when(F.col("location") != "", F.col("location"))))


def select_within(items: list[dict], budget: int, most: int = MOST_SOURCES) -> list[dict]:
    """Specialists first, then the best three of each sub-question, then the rest by score. What is
    too like something chosen, or over the budget, is passed over (the first is always taken).
    Chosen items are grouped by document in the order of their documents' first item."""
    place = {a: i for i, a in enumerate(SPECIALISTS)}
    special = sorted((x for x in items if x["agent"] in place), key=lambda x: (place[x["agent"]], -x["score"]))
    plain = sorted((x for x in items if x["agent"] not in place), key=lambda x: -x["score"])
    taken_of: dict = {}
    lead = []
    for x in plain:
        if taken_of.get(x.get("sub"), 0) < PER_SUBQUERY:
            taken_of[x.get("sub")] = taken_of.get(x.get("sub"), 0) + 1
            lead.append(x)
    used, chosen = 0, []
    for x in [*special, *lead, *plain]:
        cost = max(1, -(-len(x["content"]) * 10 // 32))
        if len(chosen) >= most or any(x["id"] == c["id"] for c in chosen):
            continue
        if chosen and used + cost > budget:
            continue
        if any(S.ratio(x["content"][:SAME_CHARS], c["content"][:SAME_CHARS]) > SAME_RATIO for c in chosen):
            continue
        chosen.append(x)
        used += cost
    docs = list(dict.fromkeys(c["doc_id"] for c in chosen))
    return [c for d in docs for c in chosen if c["doc_id"] == d]


def select(evidence: DataFrame, budget: int = 6000, most: int = MOST_SOURCES) -> DataFrame:
    """``(qid, s, id, agent, content, score, doc_id)``: numbered sources of each question."""
    sub = F.col("sub") if "sub" in evidence.columns else F.lit(None).cast("string")
    names = ["qid", "s", "id", "agent", "content", "score", "doc_id"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for qid, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, x in enumerate(select_within(items, budget, most), 1):
                    out.append((qid, i, x["id"], x["agent"], x["content"], x["score"], x["doc_id"]))
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    item = F.struct(
        (-F.col("score")).cast("double").alias("o"), F.col("id").cast("string").alias("id"), "agent",
        F.coalesce("content", F.lit("")).alias("content"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
        F.col("doc_id").cast("string").alias("doc_id"), sub.alias("sub"),
    )
    rows = evidence.groupBy(F.col("qid").cast("long").alias("qid")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return rows.mapInArrow(run, "qid long, s int, id string, agent string, content string, score double, doc_id string")


def abstains(evidence: DataFrame, least: float = 0.45) -> DataFrame:
    """``(qid, reason)``: low_relevance unless a specialist has 0.5 or the best source is over ``least``."""
    special = F.max(F.when(F.col("agent").isin(*SPECIALISTS), F.col("score")))
    best = F.max("score")
    weak = ~((F.coalesce(special, F.lit(0.0)) >= 0.5) | (F.coalesce(best, F.lit(0.0)) >= least))
    return evidence.groupBy("qid").agg(F.when(weak, "low_relevance").alias("reason"))


def claims(answers: DataFrame, id_col: str = "qid", text_col: str = "answer") -> DataFrame:
    """``(qid, place, claim)``, claims in order."""
    return answers.select(F.col(id_col).alias("qid"), F.posexplode(T.split_claims(text_col)).alias("place", "claim"))


def verify(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """A verdict for each claim of each answer: ``(qid, place, claim, citations, label, reason)``.

    ``sources`` is (qid, s, content). Rules decide: numbers must be in the cited sources, nearly all
    terms must be, and exactly one side may not be negated. A claim whose citation fails is moved to
    the one source of its question that fits; what rules leave open is partial."""
    rows = claims(answers).select(
        "qid",
        "place",
        "claim",
        T.is_factual("claim").alias("factual"),
        T.strip_citations("claim").alias("plain"),
        T.numbers("claim").alias("nums"),
        T.cited_ids("claim").alias("cited"),
    )
    rows = rows.withColumn("terms", F.array_distinct(T.tokens("plain"))).withColumn(
        "key_nums", F.filter("nums", lambda n: ~T.is_year(n))
    )
    known = sources.select(
        "qid", "s", "content", T.numbers("content").alias("src_nums"), T.tokens("content").alias("src_terms")
    )
    pairs = rows.join(known, "qid")
    ratio = S.token_set_ratio_udf()
    quote = S.best_quote_udf()
    pairs = pairs.withColumns(
        {
            "is_cited": F.array_contains("cited", F.col("s")),
            "has_numbers": F.size(F.array_except("key_nums", "src_nums")) == 0,
            "coverage": T.term_coverage(F.col("terms"), F.col("src_terms")),
            "quote": quote(F.col("plain"), F.col("content")),
        }
    )
    pairs = pairs.withColumn("alike", ratio(F.lower("plain"), F.lower("quote")))
    enough = F.when(F.size("key_nums") > 0, COVERAGE_NUMERIC).otherwise(COVERAGE)
    fits = F.col("has_numbers") & (F.col("coverage") >= enough) & ~T.negation_mismatch("plain", "quote")
    pairs = pairs.withColumn("fits", fits)
    per_claim = pairs.groupBy("qid", "place", "claim").agg(
        F.first("factual").alias("factual"),
        F.first("key_nums").alias("key_nums"),
        F.bool_or(F.col("is_cited")).alias("cites"),
        F.bool_or(F.col("is_cited") & F.col("fits")).alias("held"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("is_cited"), F.col("src_nums"))))).alias("cited_nums"),
        F.sort_array(F.collect_list(F.when(F.col("is_cited"), F.col("s")))).alias("valid"),
        F.max_by(
            F.col("s"),
            F.when(
                F.col("has_numbers") & (F.col("alike") >= REPAIR_RATIO),
                F.struct(F.col("fits"), F.col("coverage"), F.col("alike"), (-F.col("s")).alias("first")),
            ),
        ).alias("better"),
        F.max(F.when(F.col("has_numbers") & (F.col("alike") >= REPAIR_RATIO), F.col("fits"))).alias("better_fits"),
    )
    missing = F.array_except("key_nums", "cited_nums")
    label = (
        F.when(~F.col("factual"), "not_factual")
        .when(F.col("held"), "supported")
        .when(F.col("better").isNotNull() & F.coalesce("better_fits", F.lit(False)), "supported")
        .when(~F.col("cites"), "uncited")
        .when(F.size(missing) > 0, "unsupported")
        .otherwise("partial")
    )
    moved = ~F.col("held") & F.col("factual") & F.col("better").isNotNull() & F.coalesce("better_fits", F.lit(False))
    reason = (
        F.when(moved & F.col("cites"), "citation moved to the source that fits")
        .when(moved, "citation added")
        .when(
            F.col("factual") & F.col("cites") & ~F.col("held") & (F.size(missing) > 0),
            F.concat(F.lit("number(s) "), F.array_join(missing, ", "), F.lit(" not found in the cited source")),
        )
        .otherwise("")
    )
    return per_claim.select(
        "qid",
        "place",
        "claim",
        F.when(moved, F.array("better")).otherwise(F.col("valid")).alias("citations"),
        label.alias("label"),
        reason.alias("reason"),
    )


def repaired(claim: Column, citations: Column) -> Column:
    """The claim with exactly these citations at its end."""
    marks = F.array_join(F.transform(citations, lambda s: F.concat(F.lit("[S"), s.cast("string"), F.lit("]"))), "")
    plain = T.strip_citations(claim)
    return F.when(F.size(citations) == 0, plain).otherwise(F.concat(plain, F.lit(" "), marks))


def remove_unsupported(answer: str, unsupported: list[str]) -> str:
    """The answer without these sentences; bullets and blank lines stay where text is left."""
    out = []
    for line in answer.split("\n"):
        kept = line
        for claim in unsupported:
            kept = kept.replace(claim, "")
        if kept == line or re.sub(r"^\s*(?:[-*•]|\d+[.)])?\s*", "", kept).strip():
            out.append(re.sub(r"(?<=\S) {2,}", " ", kept).rstrip() if kept != line else kept)
    return "\n".join(out).strip()


def without_unsupported(answers: DataFrame, text_col: str = "answer", claims_col: str = "unsupported") -> DataFrame:
    """Adds ``supported``: the answer without the sentences in ``claims_col``; a null answer stays null."""

    def run(text: pd.Series, claims: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else remove_unsupported(t, [c for c in (() if k is None else k) if c]) for t, k in zip(text, claims, strict=True)])

    return answers.withColumn("supported", F.pandas_udf(run, "string")(text_col, claims_col))


_CITE = re.compile(r"\[\s*(S?\d+(?:\s*[,;]\s*S?\d+)*)\s*\]")


def renumber_text(text: str, n_sources: int) -> tuple[str, list[int]]:
    """[S3] marks to [1], [2] by first appearance; marks outside the sources go; the order is returned."""
    order: list[int] = []

    def mark(m: re.Match) -> str:
        ids = [int(p.strip().lstrip("Ss")) for p in re.split("[,;]", m[1])]
        good = list(dict.fromkeys(i for i in ids if 1 <= i <= n_sources))
        order.extend(i for i in good if i not in order)
        return "".join([f"[{order.index(i) + 1}]" for i in good])

    made = _CITE.sub(mark, text)
    made = re.sub(r"(\[\d+\])(?:\s*\1)+", r"\1", made)
    return re.sub(r"\s+([.,;:!?])", r"\1", made).strip(), order


def renumber(answers: DataFrame, text_col: str = "answer", sources_col: str = "n_sources") -> DataFrame:
    """Adds ``final`` and ``order`` (source numbers in citation order)."""

    def run(text: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = [renumber_text(t or "", int(k)) for t, k in zip(text, n, strict=True)]
        return pd.DataFrame(rows, columns=["final", "order"])

    made = F.pandas_udf(run, "final string, order array<int>")(text_col, sources_col)
    return answers.withColumn("__made", made).select("*", "__made.final", "__made.order").drop("__made")


def confidence(verdicts: DataFrame, citations: DataFrame) -> DataFrame:
    """``(qid, score, band, verified, retrieval, coverage, numeric)`` from verdicts (qid, claim,
    citations, label, reason) and the cited sources (qid, agent, score)."""
    factual = F.col("label") != "not_factual"
    points = F.when(F.col("label") == "supported", 1.0).when(F.col("label") == "partial", 0.5).otherwise(0.0)
    with_number = factual & F.col("claim").rlike(r"\d")
    bad = with_number & (F.col("label") == "unsupported") & F.col("reason").contains("number")
    per = verdicts.groupBy("qid").agg(
        F.count_if(factual).alias("n"),
        F.avg(F.when(factual, points)).alias("verified"),
        F.avg(F.when(factual, (F.size("citations") > 0).cast("double"))).alias("coverage"),
        F.count_if(with_number).alias("n_numeric"),
        F.count_if(bad).alias("n_bad"),
    )
    cited = citations.groupBy("qid").agg(
        F.avg("score").alias("retrieval"), F.bool_and(F.col("agent") == "vision").alias("only_vision")
    )
    both = per.join(cited, "qid", "left").withColumn("retrieval", F.coalesce("retrieval", F.lit(0.0)))
    numeric = F.when(F.col("n_numeric") > 0, 1 - F.col("n_bad") / F.col("n_numeric")).otherwise(1.0)
    both = both.withColumn("numeric", numeric)
    value = sum((F.lit(w) * F.col(k) for k, w in WEIGHTS.items()), F.lit(0.0))
    value = F.when(F.col("n_bad") > 0, F.least(value, F.lit(0.5))).otherwise(value)
    value = F.when(F.coalesce("only_vision", F.lit(False)), value * 0.85).otherwise(value)
    value = F.when(F.col("n") == 0, F.lit(0.3)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 3))
    zero = lambda c: F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.round(c, 3)).alias(c)
    scored = both.withColumn("score", value)
    band = F.when(F.col("n") == 0, "low").when(F.col("score") >= 0.75, "high").when(F.col("score") >= 0.5, "medium")
    return scored.select(
        "qid", "score", band.otherwise("low").alias("band"), *(zero(c) for c in ("verified", "retrieval", "coverage", "numeric"))
    )
