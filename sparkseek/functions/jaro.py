"""Jaro-Winkler similarity on characters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def jaro(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, mine = [True] * len(b), []
    for i, c in enumerate(a):
        j = b.find(c, max(0, i - reach), min(len(b), i + reach + 1))
        while j >= 0 and not free[j]:
            j = b.find(c, j + 1, min(len(b), i + reach + 1))
        if j >= 0:
            free[j] = False
            mine.append(c)
    if not mine:
        return 0.0
    theirs = [c for c, f in zip(b, free) if not f]
    crossed = sum(x != y for x, y in zip(mine, theirs)) // 2
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - crossed) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro, raised for up to four common first characters where it is over 0.7."""
    base = jaro(a, b)
    if base <= 0.7:
        return base
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return min(1.0, base + 0.1 * same * (1 - base))


def similarity(a: Column, b: Column) -> Column:
    @F.pandas_udf(DoubleType())
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([None if p is None or q is None else jaro_winkler(p, q) for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def best_part(a: Column, parts: Column) -> Column:
    """struct<score, at>: the part most similar to a, the first of equals; no parts give (-1, 0)."""

    @F.pandas_udf(StructType([StructField("score", DoubleType()), StructField("at", DoubleType())]))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, ys in batches:
            out = []
            for p, q in zip(x, ys):
                scores = [jaro_winkler(p, s) for s in q] if q is not None else []
                top = max(scores, default=-1.0)
                out.append((top, float(scores.index(top)) if scores else 0.0))
            yield pd.DataFrame(out, columns=["score", "at"])

    return run(a, parts)


