"""Calendar expressions and gap filling."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_STEP = {"day": "interval 1 day", "month": "interval 1 month"}


def ntz(value: dt.datetime) -> Column:
    """Zone-free timestamp literal."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def day(ts: Column | str) -> Column:
    return F.col(ts).cast("date") if isinstance(ts, str) else ts.cast("date")


def month_start(ts: Column | str) -> Column:
    return F.trunc(day(ts), "month")


def week_start(ts: Column | str) -> Column:
    """Monday of the week, as a date."""
    return F.trunc(day(ts), "week")


def month_boundaries(start: Column | str, end: Column | str) -> Column:
    """Month boundaries crossed from start to end (Jan 31 to Feb 1 counts one)."""
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    years = F.year(end) - F.year(start)
    return (years * 12 + F.month(end) - F.month(start)).cast("bigint")


def day_boundaries(start: Column, end: Column) -> Column:
    """Midnights crossed from start to end; both may be dates or timestamps."""
    return F.datediff(day(end), day(start)).cast("bigint")


def gap_fill(
    df: DataFrame,
    slot: str,
    step: str,
    until: dt.date | None = None,
    keys: Sequence[str] = (),
    fill: Mapping[str, object] | None = None,
    real: str | None = None,
) -> DataFrame:
    """Make a per-key series of days or months gap-free.

    `df` has one row per (keys, slot). Each row is stretched up to the slot before
    the next one (the last row up to `until`), so neither a spine table nor a join
    is needed: one window over the already aggregated rows does the work.
    Stretched rows take the `fill` values; `real` names a flag for original rows.
    """
    if until is not None:
        df = df.filter(F.col(slot) <= F.lit(until))
    following = F.lead(slot).over(Window.partitionBy(*keys).orderBy(slot))
    previous_slot = F.date_sub(following, 1) if step == "day" else F.add_months(following, -1)
    last = F.coalesce(previous_slot, F.lit(until) if until is not None else F.col(slot))
    out = df.withColumn("_last", last).withColumn(
        "_slot", F.explode(F.sequence(F.col(slot), F.col("_last"), F.expr(_STEP[step])))
    )
    original = F.col("_slot") == F.col(slot)
    for name, value in (fill or {}).items():
        out = out.withColumn(
            name, F.when(original, F.col(name)).otherwise(F.lit(value).cast(df.schema[name].dataType))
        )
    if real:
        out = out.withColumn(real, original)
    return out.withColumn(slot, F.col("_slot")).drop("_slot", "_last")


def date_dimension(bounds: DataFrame) -> DataFrame:
    """Calendar table for a one-row frame with columns `start` and `end`."""
    # A sequence that runs backwards is an error in Spark; here it means an empty calendar.
    whole = F.when(F.col("start") <= F.col("end"), F.sequence("start", "end", F.expr("interval 1 day")))
    days = bounds.select(F.explode(whole).alias("date"))
    return days.select(
        "date",
        F.year("date").cast("bigint").alias("year"),
        F.month("date").cast("bigint").alias("month"),
        F.date_format("date", "yyyy-MM").alias("year_month"),
        (F.dayofweek("date") - 1).cast("bigint").alias("day_of_week"),
        week_start("date").alias("week_start"),
    )


def dim_date(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    return date_dimension(spark.range(1).select(F.lit(start).alias("start"), F.lit(end).alias("end")))


def black_friday(week: Column, after_thanksgiving: bool = False) -> Column:
    """Black Friday in the year of a week's Monday.

    Default: the 4th Friday of November. With `after_thanksgiving`: the day after
    the 4th Thursday, which is a week later when November starts on a Friday.
    """
    october_end = F.make_date(F.year(week), F.lit(10), F.lit(31))
    if after_thanksgiving:
        return F.date_add(F.next_day(october_end, "Thu"), 22)
    return F.date_add(F.next_day(october_end, "Fri"), 21)


def holiday_flags(df: DataFrame, week: str = "week", after_thanksgiving: bool = False) -> DataFrame:
    """Add 0/1 columns for the Black Friday week and the Christmas week."""
    monday = F.col(week)
    friday = black_friday(monday, after_thanksgiving)
    in_week = (friday >= monday) & (friday < F.date_add(monday, 7))
    # Mondays of 19 to 31 December open a Christmas week.
    christmas = (F.month(monday) == 12) & F.dayofmonth(monday).between(19, 31)
    return df.withColumns(
        {"black_friday_week": in_week.cast("int"), "christmas_week": christmas.cast("int")}
    )
