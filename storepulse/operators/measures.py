"""Business measures that can be cut by any grouping and filter.

`tables` maps star-schema names to frames. A filter is a Column or a SQL condition.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storepulse.functions.stats import ratio
from storepulse.operators.forecast import weekly_series
from storepulse.rules import Rules

def _revenue() -> Column:
    return F.sum(F.when(F.col("is_revenue_order"), F.col("gross_revenue"))).cast("double")


def _orders() -> Column:
    """Order ids are unique in the order fact (a data test sees to it), so rows are counted, not ids."""
    return F.count(F.when(F.col("is_revenue_order"), F.col("order_id")))


def _people(only_repeat: bool) -> Column:
    """Persons are unique in their dimension."""
    person = F.col("customer_unique_id")
    return F.count(F.when(F.col("is_repeat_customer"), person) if only_repeat else person)


# name -> (star table, aggregate)
MEASURES: dict[str, tuple[str, Callable[[], Column]]] = {
    "gross_revenue": ("fct_orders", _revenue),
    "revenue_orders": ("fct_orders", _orders),
    "average_order_value": ("fct_orders", lambda: ratio(_revenue(), _orders())),
    "mqls": ("fct_lead_funnel", lambda: F.count(F.lit(1))),
    "won_deals": ("fct_lead_funnel", lambda: F.count_if("is_won")),
    "activated_sellers": ("fct_lead_funnel", lambda: F.count_if("is_activated")),
    "lead_to_win_rate": ("fct_lead_funnel", lambda: ratio(F.count_if("is_won"), F.count(F.lit(1)))),
    "win_to_activation_rate": (
        "fct_lead_funnel", lambda: ratio(F.count_if("is_activated"), F.count_if("is_won")),
    ),
    "median_days_to_close": ("fct_lead_funnel", lambda: F.percentile("days_to_close", 0.5)),
    "customers": ("dim_customers", lambda: _people(False)),
    "repeat_customer_rate": ("dim_customers", lambda: ratio(_people(True), _people(False))),
    "active_sellers": (
        "fct_seller_monthly", lambda: F.countDistinct(F.when(F.col("is_active"), F.col("seller_id"))),
    ),
}


def measures(
    names: Sequence[str],
    tables: Mapping[str, DataFrame],
    by: Sequence[str | Column] = (),
    where: Column | str | None = None,
) -> DataFrame:
    """Several measures of one star table in one pass: one row per group of `by`."""
    sources = {MEASURES[n][0] for n in names}
    if len(sources) != 1:
        raise ValueError(f"measures of one call must share a table, got {sorted(sources)}")
    df = tables[sources.pop()]
    if where is not None:
        df = df.filter(where)
    return df.groupBy(*by).agg(*[MEASURES[n][1]().alias(n) for n in names])


def measure(
    name: str, tables: Mapping[str, DataFrame], by: Sequence[str | Column] = (), where: Column | str | None = None
) -> DataFrame:
    return measures([name], tables, by, where)


def revenue_change(orders_fact: DataFrame, months_back: int, by: Sequence[str] = ()) -> DataFrame:
    """Monthly revenue against the month `months_back` earlier (1 = MoM, 12 = YoY).

    The earlier month is found by its calendar distance, so missing months give NULL
    instead of a wrong neighbour.
    """
    monthly = orders_fact.filter("is_revenue_order").groupBy(*by, F.col("order_month").alias("month")).agg(
        F.sum("gross_revenue").cast("double").alias("gross_revenue")
    )
    index = F.year("month") * 12 + F.month("month")
    earlier = Window.partitionBy(*by).orderBy(index).rangeBetween(-months_back, -months_back)
    before = F.sum("gross_revenue").over(earlier)
    return monthly.select(*by, "month", "gross_revenue", before.alias("prior_revenue")).withColumn(
        "change", ratio(F.col("gross_revenue") - F.col("prior_revenue"), F.col("prior_revenue"))
    )


def churn_setwise(months: DataFrame, entity: str, r: Rules) -> DataFrame:
    """(active last month EXCEPT active this month) / active last month, for every month.

    Each active month puts its entity into this month's set and into the next month's
    `previous` set; one grouping then compares the sets without a join.
    """
    here = F.struct(F.col("month").alias("month"), F.lit(True).alias("now"), F.lit(False).alias("before"))
    after = F.struct(F.add_months("month", 1).alias("month"), F.lit(False).alias("now"), F.lit(True).alias("before"))
    member = months.select(entity, F.inline(F.array(here, after))).groupBy(entity, "month").agg(
        F.bool_or("now").alias("now"), F.bool_or("before").alias("before")
    )
    per_month = member.filter(F.col("month") <= F.lit(r.end_month)).groupBy("month").agg(
        F.count_if("before").alias("prev_active"),
        F.count_if(F.col("before") & ~F.col("now")).alias("lost"),
    )
    return per_month.withColumn("churn_rate", ratio(F.col("lost"), F.col("prev_active")))


def actual_vs_forecast(weekly: DataFrame, forecast: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Weekly actuals followed by the forecast with its band, for the trend chart."""
    none = F.lit(None).cast("double")
    actual = weekly.select(
        *keys, "week", F.col("value").alias("actual"), none.alias("forecast"),
        none.alias("lower_80"), none.alias("upper_80"),
    )
    ahead = forecast.select(*keys, "week", none.alias("actual"), "forecast", "lower_80", "upper_80")
    return actual.unionByName(ahead)


def weekly_revenue(daily: DataFrame, r: Rules, keys: Sequence[str] = ()) -> DataFrame:
    return weekly_series(daily, r, "gross_revenue", keys).withColumnRenamed("value", "revenue")
