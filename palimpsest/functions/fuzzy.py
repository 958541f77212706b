"""Likeness of short strings. What Spark lacks runs in Arrow batches, each string pair on its own."""

from __future__ import annotations

import difflib
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two strings, in this order; 0 if one is empty or null."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def common_length(pattern: str, text: str) -> int:
    """Length of a longest common subsequence, by bits of one whole number."""
    full = (1 << len(pattern)) - 1
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    row = full
    for c in text:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(pattern) - row.bit_count()


def partial(a: str, b: str, above: float = 0.0) -> float:
    """100 times the best likeness 2 |LCS| / (|a| + |window|) of the shorter string and a window of the longer.

    Windows are as long as the shorter string, or cut off at the ends; with equal lengths both orders count. 0 if
    nothing is likelier than `above`. A step of the window changes |LCS| by one at most, so windows that can't be
    better than the best one so far are skipped.
    """
    if not a or not b:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = _slide(short, long, above / 100)
    if len(a) == len(b):
        best = max(best, _slide(long, short, max(best, above / 100)))
    return 100 * best


def _slide(needle: str, text: str, floor: float) -> float:
    n, m, best, found = len(needle), len(text), floor, 0.0
    at = 1 - n
    while at < m:
        window = text[max(0, at) : at + n]
        size = len(window)
        if 2 * min(n, size) / (n + size) <= best:  # even a whole hit would not do
            at += 1
            continue
        common = common_length(needle, window)
        like = 2 * common / (n + size)
        if like > best:
            best = found = like
            if best == 1.0:
                break
        if at < 0:  # the window grows
            step = (best * (n + size) / 2 - common) / (1 - best / 2)
            at = min(at + max(1, math.ceil(step - 1e-9)), max(0, at + 1)) if m >= n else at + 1
        elif at + n <= m:
            step = best * n - common
            at = min(at + max(1, math.ceil(step - 1e-9)), max(m - n + 1, at + 1))
        else:
            step = n + size - 2 * common / best if best else 1
            at += max(1, math.ceil(step - 1e-9))
    return found


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def token_recall(query: pd.Series, other: pd.Series, least: pd.Series) -> pd.Series:
    """Mean over the query's words of their best ratio with a word of the other: 1 from `least` on, else half of it."""

    def one(q: list[str], o: list[str], t: float) -> float:
        if not q or not o:
            return 0.0
        total = 0.0
        for x in q:
            best = max(difflib.SequenceMatcher(None, x, y).ratio() for y in o)
            total += 1.0 if best >= t else best / 2
        return total / len(q)

    return pd.Series([one(q.split(), o.split(), t) for q, o, t in zip(query.fillna(""), other.fillna(""), least, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def best_word(word: pd.Series, other: pd.Series) -> pd.Series:
    """The best ratio of the word with one of the other's words; 0 without any."""
    return pd.Series([max((difflib.SequenceMatcher(None, w, o).ratio() for o in dict.fromkeys(y.split())), default=0.0) if w else 0.0 for w, y in zip(word.fillna(""), other.fillna(""), strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def best_of(text: pd.Series, others: pd.Series) -> pd.Series:
    """The best ratio of the text with one of an array of others, whatever their case; 0 without any."""
    return pd.Series([max((difflib.SequenceMatcher(None, t.lower(), o.lower()).ratio() for o in (os if os is not None else ())), default=0.0) for t, os in zip(text, others, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def best_pair(texts: pd.Series, others: pd.Series) -> pd.Series:
    """The best ratio of one of an array of texts with one of an array of others, whatever their case; 0 without any."""

    def one(ts, os) -> float:
        return max((difflib.SequenceMatcher(None, t.lower(), o.lower()).ratio() for t in ts for o in os), default=0.0) if ts is not None and os is not None else 0.0

    return pd.Series([one(t, o) for t, o in zip(texts, others, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def python_round(x: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounding of the exact binary value, as Python has it."""
    return pd.Series([None if pd.isna(v) else round(float(v), int(d)) for v, d in zip(x, digits, strict=True)], dtype="float64")


def words_of(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("[a-z0-9]+"), 0)


def word_overlap(query: Column, other: Column) -> Column:
    """Part of the query's words (repeats count) that are words of the other; 0 without words."""
    q = words_of(query)
    return F.when(F.size(q) > 0, F.size(F.filter(q, lambda w: F.array_contains(words_of(other), w))) / F.size(q)).otherwise(0.0)


def partial_words(query: Column, other: Column) -> Column:
    """Part of the query's words that are substrings of the other."""
    q = words_of(query)
    return F.when(F.size(q) > 0, F.size(F.filter(q, lambda w: F.contains(other, w))) / F.size(q)).otherwise(0.0)


def year_score(wanted: Column, year: Column) -> Column:
    """1 for the same year, .6 for the next, .3 up to three apart, else 0; 0 for a missing one."""
    d = F.abs(wanted.cast("int") - year.cast("int"))
    return F.when(d == 0, 1.0).when(d == 1, 0.6).when(d <= 3, 0.3).otherwise(0.0)


#: Length of the pieces by which texts are found that hold others.
GRAM = 4


def grams_of(text: Column, most: int = GRAM) -> Column:
    """All pieces of a text with 1 to `most` characters, each once: one of them is piece_of() any text that it holds."""
    n = F.length(text)

    def of_length(k: int) -> Column:
        starts = F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(k)))

    return F.array_distinct(F.concat(*(of_length(k) for k in range(1, most + 1))))


def piece_of(text: Column, most: int = GRAM) -> Column:
    """One piece of the text, as long as can be up to `most`: that with the smallest hash, so that common ones are rarely chosen."""
    k = F.least(F.length(text), F.lit(most))
    pieces = F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substring(text, i, k))
    return F.when(F.length(text) > 0, F.array_min(F.transform(pieces, lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"])
