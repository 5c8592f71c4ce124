"""Indel similarity, the one measure Spark has no built-in for."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need not have this package: the helpers travel with the function that uses them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _lcs_length(a: str, b: str) -> int:
    """Longest common subsequence with one machine word per string (any length)."""
    if len(a) > len(b):
        a, b = b, a
    full = (1 << len(a)) - 1
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _similarity(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * _lcs_length(a, b) / total


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * 2 * LCS / (len a + len b), one Arrow batch at a time."""
    return pd.Series([_similarity(x, y) for x, y in zip(a, b)], dtype="float64")
