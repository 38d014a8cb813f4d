"""Toxicity by multiple-instance learning: sentences are instances, documents are bags.

A sentence's score is logistic in the hashed words and word beginnings it holds; a document's score
is the noisy-or of its sentences, 1 - prod(1 - p). Only documents carry labels: the gradient of the
noisy-or likelihood shares a document's label among its sentences, so training learns which
sentences are to blame, and ``sentences`` locates them.

Training runs on the driver, on at most ``POSITIVES`` + ``NEGATIVES`` labelled documents that are
not held out, those with the smallest hash of their id; copies of a text count once. Scoring is a
map over all rows with the weights of the features in use.

Defined results: null, empty and wordless texts have no sentence and score the bias of an empty
sentence; sentences are cut after ``SENTENCE_WORDS`` words, so a text without full stops is no
special case; a null doc_id is not held out; repeated rows repeat their score; labels that disagree
for an id count by their maximum; without labels of both kinds every score is 0; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.runtime import ship

POSITIVES, NEGATIVES, BITS, SENTENCE_WORDS, CACHE = 2500, 5000, 20, 30, 200_000
ROUNDS, RATE, DECAY, LEAST_DOCS, LIFT = 100, 0.3, 1e-6, 4, 6.0
_ENDS = re.compile(r"[.!?\n\r]+")
_WORDS = re.compile(r"\w+").findall


def sentences_of(text: str) -> list[list[str]]:
    """Lower-cased words, sentence by sentence."""
    out = []
    for part in _ENDS.split(text.lower()):
        words = _WORDS(part)
        out.extend(words[i : i + SENTENCE_WORDS] for i in range(0, len(words), SENTENCE_WORDS))
    return out


def features(word: str) -> list[int]:
    """Hashes of the word and of its beginnings of three to six characters."""
    cut = [word[:n] + "*" for n in range(3, min(6, len(word) - 1) + 1)]
    return [zlib.crc32(f.encode()) & ((1 << BITS) - 1) for f in [word, *cut]]


def noisy_or(scores: list[float]) -> float:
    return -math.expm1(sum([math.log1p(-min(p, 1 - 1e-12)) for p in scores]))


class Model:
    def __init__(self, bias: float = -30.0, weights: dict[int, float] | None = None):
        self.bias, self.weights = bias, weights or {}
        self.known: dict[str, float] = {}

    def _total(self, words: list[str]) -> float:
        known = self.known
        try:
            return sum([known[w] for w in words])
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            get = self.weights.get
            for w in words:
                if w not in known:
                    known[w] = sum([get(f, 0.0) for f in features(w)])
            return sum([known[w] for w in words])

    def _chances(self, parts: list[list[str]]) -> list[float]:
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self._total(p))))) for p in parts]

    def sentences(self, text: str) -> list[tuple[str, float]]:
        parts = sentences_of(text)
        return list(zip([" ".join(p) for p in parts], self._chances(parts), strict=True))

    def score(self, text: str) -> float:
        return min(1.0, max(0.0, noisy_or(self._chances(sentences_of(text) or [[]]))))


def _telling(texts: list[str], y: np.ndarray) -> np.ndarray:
    """Which features are found in toxic documents ``LIFT`` times as often as in others, and in
    ``LEAST_DOCS`` of them or more. Noisy-or needs evidence for, not against: the rest is noise."""
    found = np.zeros((2, 1 << BITS), np.int32)
    memo: dict[str, list[int]] = {}
    for text, label in zip(texts, y, strict=True):
        mine: set[int] = set()
        for w in {w for words in sentences_of(text) for w in words}:
            if w not in memo:
                if len(memo) > CACHE:
                    memo.clear()
                memo[w] = features(w)
            mine.update(memo[w])
        found[int(label > 0), list(mine)] += 1
    for_toxic = (found[1] + 0.5) / (y > 0).sum()
    return (found[1] >= LEAST_DOCS) & (for_toxic >= LIFT * (found[0] + 0.5) / (y <= 0).sum())


def fit(texts: list[str], labels: list[int]) -> Model:
    """Weights by Adagrad on the noisy-or likelihood, over the telling features."""
    y = np.array(labels, np.float64)
    if not (0 < y.sum() < len(y)):
        return Model()
    telling = _telling(texts, y)
    cell_list: list[int] = []
    owner_list: list[int] = []
    bag_list: list[int] = []
    memo: dict[str, list[int]] = {}
    for d, text in enumerate(texts):
        for words in sentences_of(text) or [[]]:
            for w in words:
                if w not in memo:
                    if len(memo) > CACHE:
                        memo.clear()
                    memo[w] = [f for f in features(w) if telling[f]]
                if memo[w]:
                    cell_list += memo[w]
                    owner_list += [len(bag_list)] * len(memo[w])
            bag_list.append(d)
    cell, owner, bag = np.array(cell_list, np.int64), np.array(owner_list, np.int64), np.array(bag_list)
    n = len(bag)
    used, cell = np.unique(cell, return_inverse=True)
    w, bias = np.ones(len(used)), -5.0
    seen, seen_bias = np.full(len(used), 1e-10), 1e-10
    for _ in range(ROUNDS):
        z = bias + np.bincount(owner, w[cell], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_clean = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))
        whole = np.maximum(-np.expm1(log_clean), 1e-12)
        share = np.where(y > 0, -(1 - whole) / whole, 1.0)
        pull = share[bag] * p / len(y)
        grad = np.bincount(cell, pull[owner], minlength=len(used)) + DECAY * w
        seen += grad**2
        w -= RATE * grad / np.sqrt(seen)
        g = pull.sum()
        seen_bias += g * g
        bias -= RATE * g / math.sqrt(seen_bias)
    return Model(float(bias), {int(f): float(x) for f, x in zip(used, w, strict=True) if abs(x) > 0.02})


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the bounded sample of labelled, not held-out documents.

    The sample is drawn from ids and hashes of texts; only the texts drawn, at most ``POSITIVES`` +
    ``NEGATIVES``, are moved: their ids are broadcast to the documents."""
    told = (
        labels.filter(F.col("toxic").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.max("toxic").alias("y"))
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h")).join(told, "id")
    parts = [
        rows.filter(F.col("y") == value).groupBy("h").agg(F.min("id").alias("id")).orderBy("h").limit(most).withColumn("y", F.lit(value))
        for value, most in ((1, POSITIVES), (0, NEGATIVES))
    ]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    drawn = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.xxhash64(text).alias("h")).join(chosen, ["id", "h"])
    got = drawn.groupBy("y", "h").agg(F.first("t").alias("t")).toArrow().sort_by([("y", "descending"), ("h", "ascending")])
    return fit(got.column("t").to_pylist(), got.column("y").to_pylist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for every row."""
    ship(docs.sparkSession)
    bias, weights = model.bias, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Model(bias, weights)
        for batch in batches:
            found = [mine.score(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        run, f"id {dict(docs.dtypes)[id_col]}, score double"
    )


def offending(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, position, sentence, score)`` of sentences scored ``least`` or more."""
    ship(docs.sparkSession)
    bias, weights = model.bias, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Model(bias, weights)
        for batch in batches:
            rows = [
                (i.as_py(), at, s, p)
                for i, t in zip(*batch.columns, strict=True)
                for at, (s, p) in enumerate(mine.sentences(t.as_py() or ""))
                if p >= least
            ]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "position", "sentence", "score"]
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        run, f"id {dict(docs.dtypes)[id_col]}, position int, sentence string, score double"
    )


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    scored = score(docs, train(docs, labels))
    return scored.select(
        F.col("id").alias("doc_id"),
        held_out("id").alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )
