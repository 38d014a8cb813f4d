"""Indel similarity of strings, scaled to 0..100: 200 * LCS / (len a + len b).

No Catalyst expression computes a longest common subsequence, so these are Arrow-batched UDFs. The
LCS is bit-parallel (Hyyrö, 2004): one big-integer step per character of the second string.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 for two empty strings."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs_length(a, b) / total


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of its length in the longer, windows at
    the longer string's ends included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    if not n:
        return 100.0 if not long else 0.0
    best = 0.0
    for start in range(1 - n, len(long)):
        window = long[max(0, start) : start + n]
        if window and (window[-1] in short or window[0] in short):
            best = max(best, ratio(short, window))
            if best == 100.0:
                break
    return best


def token_set_ratio(a: str, b: str) -> float:
    """Compares shared words with shared words plus the rest of either side; 0 if a side has none."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = ratio(one, two)
    if both:
        best = max(best, ratio(both, one), ratio(both, two))
    return best


def best_quote(claim: str, source: str, most: int = 320) -> str:
    """The sentence of ``source`` most like ``claim``, among those sharing a number if any do."""
    from tesserae.functions.text import QUOTE_END

    found = [s.strip() for s in re.split(QUOTE_END, source) if len(s.strip()) > 3]
    if not found:
        return source[:most]
    digits = lambda t: set(re.findall(r"\d[\d,.]*\d|\d", t.replace(",", "")))
    wanted = digits(claim)
    pool = [s for s in found if wanted & digits(s)] or found
    return max(pool, key=lambda s: token_set_ratio(claim, s))[:most]


def _pairwise(fn, kind):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fn(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(run, kind)


def ratio_udf():
    return _pairwise(ratio, "double")


def partial_ratio_udf():
    return _pairwise(partial_ratio, "double")


def token_set_ratio_udf():
    return _pairwise(token_set_ratio, "double")


def best_quote_udf():
    return _pairwise(best_quote, "string")
