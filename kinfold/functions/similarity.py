"""String similarities from 0 to 1, as vectorised UDFs where Spark has no builtin.

ratio: twice the longest common subsequence over the sum of lengths; two empty strings are equal (1).
token_sort and token_set compare sorted words; token_set with an empty side is 0. partial_ratio slides
the shorter string over the longer one. All are computed once for each distinct pair of a batch.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of ``a``."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row, full = 0, (1 << len(a)) - 1
    for c in b:
        x = places.get(c, 0) | row
        row = x & ~(x - (row << 1 | 1)) & full
    return row.bit_count()


def ratio_of(a: str, b: str) -> float:
    if a == b:
        return 1.0
    return 2.0 * lcs(a, b) / (len(a) + len(b))


def partial_of(a: str, b: str) -> float:
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    n, m = len(a), len(b)
    best = 0.0
    for start in range(1 - n, m):
        window = b[max(0, start) : start + n]
        if 2.0 * len(window) / (n + len(window)) > best:
            best = max(best, ratio_of(a, window))
            if best == 1.0:
                break
    return best


def token_set_of(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 1.0
    u, v = " ".join([both, *left]).strip(), " ".join([both, *right]).strip()
    best = ratio_of(u, v)
    if both:
        best = max(best, ratio_of(both, u), ratio_of(both, v))
    return best


def jaro_winkler_of(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, mine = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, f in zip(b, free, strict=True) if not f]
    m, swaps = len(mine), sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + 0.1 * same * (1 - jaro) if jaro > 0.7 else jaro


def _paired(fn):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}

        def one(x, y):
            if (v := known.get((x, y))) is None:
                v = known[x, y] = fn(x, y)
            return v

        return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


ratio, partial_ratio, token_set, jaro_winkler = map(_paired, (ratio_of, partial_of, token_set_of, jaro_winkler_of))


def sorted_tokens(s: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(s, " "), lambda t: t != "")), " ")


def token_sort(a: Column, b: Column) -> Column:
    return ratio(sorted_tokens(a), sorted_tokens(b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; two empty ones have 0."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
