"""Acquisition funnel: conversion, intervals, cycle times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.functions.calendar import ntz
from storepulse.functions.stats import fixed_histogram, interpolated, pct, wilson_interval
from storepulse.rules import Rules

# Stage labels of the funnel report.
STAGES = ("MQL", "Won (signed)", "Activated (1st sale)", "Retained (3+ active mo.)")


def mature_leads(funnel: DataFrame, r: Rules) -> DataFrame:
    """Leads old enough to be judged; deals won after the end date count as not won yet."""
    too_late = F.coalesce(F.col("won_at") > ntz(r.end_timestamp), F.lit(False))
    old_enough = F.col("first_contact_date") <= F.lit(r.days_before_end(r.maturity_days))
    return funnel.filter(old_enough).withColumns(
        {flag: F.col(flag) & ~too_late for flag in ("is_won", "is_activated", "is_retained")}
    )


def funnel_overall(mature: DataFrame) -> DataFrame:
    """The four stages with their share of the first and of the previous stage."""
    counts = mature.agg(
        F.count(F.lit(1)).alias("c0"), F.count_if("is_won").alias("c1"),
        F.count_if("is_activated").alias("c2"), F.count_if("is_retained").alias("c3"),
    )
    stages = []
    for i, label in enumerate(STAGES):
        here = F.col(f"c{i}")
        step = pct(here, F.col(f"c{i - 1}")) if i else F.lit(None).cast("double")
        stages.append(F.struct(
            F.lit(i + 1).alias("position"), F.lit(label).alias("stage"), here.alias("count"),
            F.bround(pct(here, F.col("c0")), 2).alias("pct_of_mql"),
            F.bround(step, 1).alias("step_conversion_pct"),
        ))
    return counts.select(F.inline(F.array(*stages)))


def funnel_by(mature: DataFrame, r: Rules, dim: str = "origin") -> DataFrame:
    """Conversion per value of a dimension with a 95% Wilson interval, unrounded."""
    by = mature.groupBy(dim).agg(
        F.count(F.lit(1)).alias("mqls"), F.count_if("is_won").alias("won"),
        F.count_if("is_activated").alias("activated"),
    )
    low, high = wilson_interval(F.col("won"), F.col("mqls"), r.z95)
    return by.select(
        dim, "mqls", "won", "activated",
        pct(F.col("won"), F.col("mqls")).alias("win_rate_pct"),
        (low * 100).alias("win_ci_low"), (high * 100).alias("win_ci_high"),
        pct(F.col("activated"), F.col("won")).alias("activation_of_won_pct"),
    )


RATE_COLUMNS = ("win_rate_pct", "win_ci_low", "win_ci_high", "activation_of_won_pct")


def rounded_rates(by: DataFrame, columns: Sequence[str] = RATE_COLUMNS, digits: int = 1) -> DataFrame:
    return by.withColumns({c: F.bround(c, digits) for c in columns})


def win_rate_ranked(by: DataFrame, r: Rules, dim: str = "origin") -> DataFrame:
    """Dimension values with enough leads, by win rate, with the interval's half widths."""
    rate = F.col("win_rate_pct")
    return by.filter(F.col("mqls") >= r.min_origin_leads).select(
        dim, "mqls", "win_rate_pct",
        (rate - F.col("win_ci_low")).alias("ci_below"), (F.col("win_ci_high") - rate).alias("ci_above"),
    ).orderBy("win_rate_pct", dim)


def funnel_by_segment(funnel: DataFrame, r: Rules, dim: str = "business_segment") -> DataFrame:
    """Won leads (all of them, not only mature ones) per segment."""
    segments = funnel.filter("is_won").groupBy(dim).agg(
        F.count(F.lit(1)).alias("won"),
        F.count_if("is_activated").alias("activated"),
        F.percentile("days_to_close", 0.5).alias("median_days_to_close"),
        F.sum("seller_item_revenue").cast("double").alias("seller_revenue"),
    )
    return segments.filter(F.col("won") >= r.min_segment_won).withColumn(
        "activation_pct", F.bround(pct(F.col("activated"), F.col("won")), 1)
    ).orderBy(F.desc("won"), dim)


TIMING_COLUMNS = ("days_to_close", "days_won_to_first_sale")


def funnel_timing(
    funnel: DataFrame, columns: Sequence[str] = TIMING_COLUMNS, exclude_negative: bool = False
) -> DataFrame:
    """Median, p75 and p90 of the cycle times over all leads."""

    def usable(c: str) -> Column:
        return F.when(F.col(c) >= 0, F.col(c)) if exclude_negative else F.col(c)

    days = funnel.select(*[usable(c).alias(c) for c in columns])
    quantiles = days.agg(*[interpolated(c, [0.5, 0.75, 0.9]).alias(c) for c in columns])
    rows = [
        F.struct(F.lit(c).alias("metric"), F.col(c)[0].alias("median"), F.col(c)[1].alias("p75"),
                 F.col(c)[2].alias("p90"))
        for c in columns
    ]
    return quantiles.select(F.inline(F.array(*rows)))


def days_to_close_histogram(funnel: DataFrame, r: Rules) -> DataFrame:
    return fixed_histogram(funnel, "days_to_close", r.hist_bins, r.hist_clip)
