"""Cohorts, churn and segments for any entity.

Churn and cohorts read active months only (entity, month): inactive months follow from
the gaps between them, so the filled panel is never needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storepulse.functions.calendar import month_boundaries
from storepulse.functions.stats import (
    exact_quantiles, interpolated, pct, quartile_score, right_closed_band,
)
from storepulse.operators.marts import window_revenue
from storepulse.rules import Rules


def customer_months(orders_fact: DataFrame) -> DataFrame:
    """(customer_unique_id, month), once per month with a revenue order in the window.
    Orders without a customer belong to nobody's history."""
    return window_revenue(orders_fact).filter("customer_unique_id is not null").select(
        "customer_unique_id", F.col("order_month").alias("month")
    ).distinct()


def cohort_retention(months: DataFrame, entity: str, min_size: int) -> DataFrame:
    """(cohort_month, age, active, size, pct): share of each start cohort active at each age.

    An entity is active in its first month by definition, so the count at age 0 is the
    cohort size and no second pass over the entities is needed. A NULL entity is nobody.
    """
    cohort = F.min("month").over(Window.partitionBy(entity))
    aged = months.filter(F.col(entity).isNotNull()).select(entity, "month").withColumn("cohort_month", cohort)
    cells = aged.groupBy(
        "cohort_month", month_boundaries("cohort_month", "month").alias("age")
    ).agg(F.count(F.lit(1)).alias("active"))
    size = F.max(F.when(F.col("age") == 0, F.col("active"))).over(Window.partitionBy("cohort_month"))
    return (
        cells.withColumn("size", size).filter(F.col("size") >= min_size)
        .withColumn("pct", pct(F.col("active"), F.col("size")))
    )


def cohort_matrix(cohorts: DataFrame, ages: Sequence[int], digits: int) -> DataFrame:
    """Wide form: one row per cohort, one column per listed age."""
    return (
        cohorts.withColumn("pct", F.bround("pct", digits)).groupBy("cohort_month")
        .pivot("age", list(ages)).agg(F.first("pct"))
    )


def purchase_days(orders_fact: DataFrame) -> DataFrame:
    """Person x day totals with the day that follows; a person's hot days collapse early."""
    days = window_revenue(orders_fact).groupBy("customer_unique_id", "order_date").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("gross_revenue").alias("revenue"),
        F.min("purchased_at").alias("first_at"),
    )
    w = Window.partitionBy("customer_unique_id").orderBy("order_date")
    return days.withColumns({"next_date": F.lead("order_date").over(w), "day_no": F.row_number().over(w)})


def customer_history(orders_fact: DataFrame) -> DataFrame:
    """Per person: first order, orders, revenue and days to the second order (NULL if none).

    Orders without a customer form a row of their own, as in the customer dimension; they
    are no person's first and second order, so that row has no gap.
    """
    first_day = (F.col("day_no") == 1) & F.col("customer_unique_id").isNotNull()
    second = F.when(F.col("orders") > 1, F.col("order_date")).otherwise(F.col("next_date"))
    return purchase_days(orders_fact).groupBy("customer_unique_id").agg(
        F.min("first_at").alias("first_order_at"),
        F.sum("orders").alias("order_count"),
        F.sum("revenue").alias("revenue"),
        F.max(F.when(first_day, F.datediff(second, "order_date"))).cast("bigint").alias("days_to_second"),
    )


def second_order_gap(orders_fact: DataFrame) -> DataFrame:
    """Days from the first to the second order, for people who have two."""
    return customer_history(orders_fact).filter(F.col("days_to_second").isNotNull()).select(
        "customer_unique_id", "days_to_second"
    )


def customer_retention_summary(orders_fact: DataFrame, r: Rules) -> DataFrame:
    """Six key figures as (metric, value), from one pass over the order fact."""
    repeat = F.col("order_count") > 1
    gap = F.col("days_to_second")
    cutoff = F.lit(r.days_before_end(r.repurchase_days).isoformat()).cast("timestamp_ntz")
    eligible = F.col("first_order_at") <= cutoff
    one = customer_history(orders_fact).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(repeat).alias("repeaters"),
        F.count_if(eligible).alias("eligible"),
        F.count_if(eligible & (gap <= r.repurchase_days)).alias("returned"),
        interpolated("days_to_second", [0.5]).alias("median"),
        F.count(gap).alias("gaps"),
        F.count_if(gap == 0).alias("same_day"),
        F.sum(F.when(repeat, F.col("revenue"))).cast("double").alias("repeat_revenue"),
        F.sum("revenue").cast("double").alias("revenue"),
    )
    # Metric names and decimals of the summary report.
    figures = (
        ("customers", F.col("n").cast("double")),
        ("repeat_customer_pct", F.bround(pct(F.col("repeaters"), F.col("n")), 2)),
        (f"repurchase_within_{r.repurchase_days}d_pct", F.bround(pct(F.col("returned"), F.col("eligible")), 2)),
        ("median_days_to_second_order", F.col("median")[0]),
        ("same_day_second_orders_pct", F.bround(pct(F.col("same_day"), F.col("gaps")), 1)),
        ("revenue_share_from_repeat_customers_pct",
         F.bround(pct(F.coalesce("repeat_revenue", F.lit(0.0)), F.col("revenue")), 1)),
    )
    rows = [F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in figures]
    return one.select(F.inline(F.array(*rows)))


# Segment names of the recency / frequency / value report.
SEGMENTS = {
    "loyal": "Loyal (repeat, recent)",
    "lapsed": "Lapsed repeat buyers",
    "new_high": "New high-value",
    "new_low": "New low-value",
    "risk_high": "At-risk high-value one-timers",
    "dormant": "Dormant low-value one-timers",
}


def rfm_scores(customers: DataFrame) -> DataFrame:
    """Quartile scores and segment per person; the most recent quarter has R = 4.

    The edges are exact. Recency has as many distinct values as the window has days, so
    its quantiles ride along with the first of the two passes that revenue takes.
    """
    quarters = [0.25, 0.5, 0.75]
    edges = exact_quantiles(
        customers, "lifetime_revenue", quarters, also=[interpolated("recency_days", quarters).alias("recency")]
    ).select(F.struct("q", "recency").alias("edges")).scalar()
    recency_edges, revenue_edges = F.col("edges.recency"), F.col("edges.q")
    revenue = F.col("lifetime_revenue").cast("double")
    scored = customers.withColumn("edges", edges).select(
        "customer_unique_id",
        "recency_days",
        "lifetime_revenue",
        (F.lit(5) - quartile_score(F.col("recency_days"), recency_edges)).alias("R"),
        F.when(F.col("order_count") >= 2, 2).otherwise(1).alias("F"),
        quartile_score(revenue, revenue_edges).alias("M"),
    )
    recent, valuable, repeat = F.col("R") >= 3, F.col("M") >= 3, F.col("F") == 2
    one_time = F.when(recent & valuable, SEGMENTS["new_high"]).when(recent, SEGMENTS["new_low"])
    one_time = one_time.when(valuable, SEGMENTS["risk_high"]).otherwise(SEGMENTS["dormant"])
    segment = F.when(repeat, F.when(recent, SEGMENTS["loyal"]).otherwise(SEGMENTS["lapsed"])).otherwise(one_time)
    return scored.withColumn("segment", segment)


def rfm_segments(scores: DataFrame) -> DataFrame:
    """Segments by revenue; shares are rounded to one decimal first and to none for the report."""
    per = scores.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("lifetime_revenue").cast("double").alias("revenue"),
        F.avg(F.col("recency_days").cast("double")).alias("avg_recency_days"),
    )
    # At most six rows reach this unpartitioned window.
    total = Window.partitionBy()

    def share(c: str):
        return F.bround(F.bround(pct(F.col(c), F.sum(c).over(total)), 1), 0)

    return per.select(
        "segment", "customers", F.bround("revenue", 0).alias("revenue"),
        F.bround("avg_recency_days", 0).alias("avg_recency_days"),
        share("customers").alias("customer_pct"), share("revenue").alias("revenue_pct"),
    ).orderBy(F.desc("revenue"), "segment")


def monthly_churn(months: DataFrame, entity: str, r: Rules) -> DataFrame:
    """Per month: entities active the month before, and how many of them were not active again.

    Each active month looks at the entity's next active month; it churns in the month
    after unless that one follows at once.
    """
    w = Window.partitionBy(entity).orderBy("month")
    following = F.add_months("month", 1)
    looked = months.filter(F.col(entity).isNotNull()).select(entity, "month", F.lead("month").over(w).alias("next_month"))
    stayed = F.coalesce(F.col("next_month") == following, F.lit(False))
    churn = looked.groupBy(following.alias("month")).agg(
        F.count(F.lit(1)).alias("active_prev"), F.count_if(~stayed).alias("churned")
    )
    return churn.filter(
        F.col("month").between(F.lit(r.churn_from), F.lit(r.last_full_month))
    ).withColumn("monthly_churn_pct", F.bround(pct(F.col("churned"), F.col("active_prev")), 1))


def avg_churn(churn: DataFrame, year: int) -> DataFrame:
    """Mean of the monthly (rounded) churn rates of a year."""
    return churn.filter(F.year("month") == year).agg(F.avg("monthly_churn_pct").alias("avg_churn_pct"))


def lifecycle_status(sellers: DataFrame) -> DataFrame:
    return sellers.groupBy("lifecycle_status").agg(
        F.count(F.lit(1)).alias("sellers"),
        F.sum("item_revenue").cast("double").alias("revenue"),
        F.avg(F.col("acquired_via_marketing_funnel").cast("double")).alias("pct_from_funnel"),
    )


def churn_by_size(sellers: DataFrame, r: Rules) -> DataFrame:
    """Churned share by band of lifetime orders, for entities that ever sold."""
    band = right_closed_band(F.col("orders"), r.size_bands)
    sold = sellers.filter(F.col("lifecycle_status") != "never_sold").withColumn("size_band", band)
    return sold.filter(F.col("size_band").isNotNull()).groupBy("size_band").agg(
        F.count(F.lit(1)).alias("sellers"),
        F.bround(pct(F.count_if(F.col("lifecycle_status") == "churned"), F.count(F.lit(1))), 1).alias("churned_pct"),
    )


def entity_status(months: DataFrame, entity: str, r: Rules) -> DataFrame:
    """Lifecycle status of every entity with a sale: the input of churn_by_size for any entity."""
    activity = months.groupBy(entity).agg(
        F.max("last_sale_at").alias("last_sale_at"), F.sum("orders").alias("orders")
    )
    idle = F.datediff(F.lit(r.analysis_end), F.col("last_sale_at").cast("date"))
    return activity.select(
        entity, "orders", F.when(idle > r.churn_days, "churned").otherwise("active").alias("lifecycle_status")
    )
