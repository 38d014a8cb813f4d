"""Conversation state: history text, summary trigger, finished turns; batch and keyed-state forms."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURNS, ANSWER_CHARS, KEEP, SUMMARISE_AFTER, SUMMARISE_EVERY = 3, 400, 6, 8, 4


def history_text(turns: DataFrame, key: str = "thread_id", order: str = "turn") -> DataFrame:
    """``turns`` with ``history``: the last three earlier questions and answers of the thread."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-TURNS, -1)
    said = F.concat(F.lit("User: "), "question", F.lit("\nAssistant: "), F.substring("answer", 1, ANSWER_CHARS))
    return turns.withColumn("history", F.array_join(F.collect_list(said).over(w), "\n"))


def summarises(turns_so_far: Column) -> Column:
    """Whether the turn that follows ``turns_so_far`` finished ones folds the older ones into the summary."""
    n = turns_so_far + 1
    return (n > SUMMARISE_AFTER) & (n % SUMMARISE_EVERY == 0)


def carried(turns: DataFrame, key: str = "thread_id", order: str = "turn") -> DataFrame:
    """The last query and last documents known before each turn, for follow-ups."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    return turns.withColumns({"last_sql": last("sql"), "active_docs": last("doc_ids")})


def follow_up_scope(turns: DataFrame) -> DataFrame:
    """One further search of a follow-up on the documents the answer before cited."""
    return turns.filter("is_followup AND active_docs IS NOT NULL").select("thread_id", "turn", F.explode("active_docs").alias("doc_id"))


_STATE, _OUT = "history string, n long", "thread_id string, n long, history string"


def stream_turns(stream: DataFrame) -> DataFrame:
    """Keyed state per thread: appended turns (thread_id, question, answer), the last KEEP kept."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, n = state.get if state.exists else ("[]", 0)
        turns = json.loads(held)
        for pdf in batches:
            turns += [{"q": q, "a": (a or "")[:ANSWER_CHARS]} for q, a in zip(pdf["question"], pdf["answer"], strict=True)]
            n += len(pdf)
        turns = turns[-KEEP:]
        state.update((json.dumps(turns), n))
        yield pd.DataFrame([(key[0], n, json.dumps(turns))], columns=["thread_id", "n", "history"])

    return stream.groupBy("thread_id").applyInPandasWithState(step, _OUT, _STATE, "update", "NoTimeout")
