"""Frames that a plan computes once, however many of its parts read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns of a frame (all by default), computed once per plan.

    Spark reads an equal shuffle of a plan only once, but column pruning and filters pushed
    down by each reader make the shuffles differ. Here the rows are dealt by a hash of all
    columns, so no reader can prune below the shuffle, and a filter that always holds but that
    the optimizer may not move keeps the readers' filters above it. Worth its shuffle where
    several parts of one plan start from a frame that costs scans and joins of larger tables;
    name only the columns that are needed.
    """
    kept = df.select(*columns) if columns else df
    return kept.repartition(F.xxhash64(*kept.columns)).filter(F.monotonically_increasing_id() >= 0)
