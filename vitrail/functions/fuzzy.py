"""Indel similarity kernel: ratio, token-set ratio, partial ratio.

`ratio` is 100 * 2 * LCS / (|a| + |b|), the LCS by bit-parallel arithmetic on
Python integers.  Column wrappers are Arrow-batched; callers score distinct pairs
only and join the scores back.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence; one big-integer step per character of b."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & where.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


@lru_cache(maxsize=100_000)
def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 * 2 * lcs_length(a, b) / n if n else 100.0


def _score(total: int, distance: int) -> float:
    return 100.0 * (1 - distance / total) if total else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """Of the words' intersection and the two rests; 100 if one set holds the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    shared = len(" ".join(sorted(both)))
    gap = 1 if shared else 0
    n_x, n_y = shared + gap + len(only_x), shared + gap + len(only_y)
    apart = len(only_x) + len(only_y) - 2 * lcs_length(only_x, only_y)
    best = _score(n_x + n_y, apart)
    if shared:
        best = max(best, _score(shared + n_x, gap + len(only_x)), _score(shared + n_y, gap + len(only_y)))
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer, windows at
    the edges being shorter."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0

    def slide(a: str, b: str) -> float:
        n = len(a)
        return max(ratio(a, b[max(0, end - n) : end]) for end in range(1, len(b) + n))

    return slide(a, b) if len(a) < len(b) else max(slide(a, b), slide(b, a))


def extract_one(query: str, choices: list[str], scorer: Callable[[str, str], float], cutoff: float) -> tuple[int, float] | None:
    """Index and score of the first best choice at or above the cutoff."""
    best, at = -1.0, -1
    for i, c in enumerate(choices):
        s = scorer(query, c)
        if s > best:
            best, at = s, i
    return (at, best) if at >= 0 and best >= cutoff else None


def plain(s: str) -> str:
    """Of table entries: lower-case words of a-z and 0-9, without accents."""
    bare = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if unicodedata.category(c) != "Mn")
    return " ".join(re.findall("[a-z0-9]+", bare))


def closest_col(query: Column, choices: list[str], scorer: Callable[[str, str], float], cutoff: float) -> Column:
    """struct<at,score>: the first best choice of a fixed list; null below the cutoff or
    without a query."""

    def batch(q: pd.Series) -> pd.DataFrame:
        hits = [extract_one(x, choices, scorer, cutoff) if x else None for x in q]
        return pd.DataFrame({"at": pd.array([h and h[0] for h in hits], "Int32"), "score": [h[1] if h else None for h in hits]})

    batch.__annotations__ = {"q": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(batch, "at int, score double")(query)


def words_met_col(words: Column, others: Column, cutoff: float) -> Column:
    """How many of `words` (array) have a word of `others` at least that close."""

    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sum(any(ratio(x, y) >= cutoff for y in ys) for x in xs) if xs is not None and ys is not None else 0 for xs, ys in zip(a, b)], dtype="int32")

    batch.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, T.IntegerType())(words, others)


def _pairwise(score: Callable[[str, str], float]):
    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([score(x or "", y or "") for x, y in zip(a, b)], dtype="float64")

    batch.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, T.DoubleType())


def ratio_col(a: Column, b: Column) -> Column:
    return _pairwise(ratio)(a, b)


def token_set_ratio_col(a: Column, b: Column) -> Column:
    return _pairwise(token_set_ratio)(a, b)


def partial_ratio_col(a: Column, b: Column) -> Column:
    return _pairwise(partial_ratio)(a, b)


def edit_distance(a: list[str], b: list[str]) -> int:
    """Levenshtein distance of two word lists, one row at a time."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def word_error_rate_col(hypothesis: Column, reference: Column) -> Column:
    return _pairwise(lambda h, r: edit_distance(h.split(), r.split()) / max(len(r.split()), 1))(hypothesis, reference)
