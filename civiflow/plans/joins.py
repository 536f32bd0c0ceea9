"""Joins by possibly missing keys.

A left row set in which one key holds a large share of the rows is left to the
skew handling of adaptive execution, which the session switches on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on all ``keys``."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Many-to-one join in which null keys match each other.

    ``right`` has one row per key. Staged tables are broadcast by Catalyst when
    their measured size allows it.
    """
    if how in ("left_semi", "left_anti"):
        return left.join(right, same(left, right, keys), how)
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])
