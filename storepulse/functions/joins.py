"""Small join helpers for frames with an optional list of series keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other, as they do in GROUP BY."""
    a, b = left.alias("a"), right.alias("b")
    same = reduce(Column.__and__, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in on])
    extra = [F.col(f"b.{c}") for c in right.columns if c not in on]
    return a.join(b, same, how).select("a.*", *extra)


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on the keys; without keys `right` has at most one row and joins as a scalar."""
    if keys:
        return match(left, right, keys, "left")
    row = right.select(F.struct(*right.columns).alias("r")).scalar()
    return left.withColumns({c: row[c] for c in right.columns})
