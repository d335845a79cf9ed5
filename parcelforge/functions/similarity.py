"""Similarities of texts, sets and numbers."""

from __future__ import annotations

import difflib
import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays; 0 if both are empty or one is null."""
    return F.coalesce(F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(a, b)), F.lit(0))


def number_proximity(a: Column, b: Column, reach: int = 140) -> Column:
    """1 for a shared number, falling to 0 at `reach` apart; null if either has none."""
    gaps = F.array_min(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.abs(x - y)))))
    return 1 - F.least(gaps, F.lit(reach)) / reach


def span_relation(a: Column, b: Column) -> Column:
    """Of two ranges struct(lo, hi): 4 equal, 2 overlapping, 0 apart or one missing, 1 both missing."""
    return (
        F.when(a.isNull() & b.isNull(), 1).when(a.isNull() | b.isNull(), 0)
        .when((a["lo"] == b["lo"]) & (a["hi"] == b["hi"]), 4)
        .when((a["lo"] <= b["hi"]) & (b["lo"] <= a["hi"]), 2).otherwise(0)
    )


@functools.lru_cache(maxsize=1 << 16)
def _ratio(a: str, b: str) -> float:
    if a and b and (a in b or b in a):
        return 1.0
    return difflib.SequenceMatcher(None, a, b).ratio()


def gestalt(a: Column, b: Column) -> Column:
    """Ratcliff/Obershelp ratio, 1.0 if one text holds the other; null if either is null. An Arrow UDF: Spark has no such function."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else _ratio(p, q) for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)
