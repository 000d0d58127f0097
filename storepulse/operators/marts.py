"""Facts and dimensions.

Grains: order, day, seller-month, lead, person, seller. Every join below is an
equi-join on a key, and each aggregation combines on the map side first, so a key
with very many rows costs one partial row per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storepulse.functions.calendar import (
    day, day_boundaries, gap_fill, month_boundaries, month_start, ntz,
)
from storepulse.rules import Rules

# Order totals leave one digit free, so that the sum of two of them still fits the 18
# digits that Spark keeps in a plain long; larger amounts raise instead of wrapping.
TOTAL = "decimal(17,2)"


def earns_revenue(status: Column, r: Rules) -> Column:
    """NULL status stays NULL, so filters drop it."""
    return ~status.isin(*r.non_revenue_statuses) if r.non_revenue_statuses else status.isNotNull()


def in_window(purchased_at: Column, r: Rules) -> Column:
    """The window closes at the midnight after the end date, that instant included by default."""
    limit = ntz(r.window_limit)
    return purchased_at < limit if r.window_end_exclusive else purchased_at <= limit


def _zero(column: str, kind: str) -> Column:
    return F.coalesce(F.col(column).cast(kind), F.lit(0).cast(kind))


def item_totals(items: DataFrame, *more: Column) -> DataFrame:
    return items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.sum("item_price").cast(TOTAL).alias("item_revenue"),
        F.sum("freight_value").cast(TOTAL).alias("freight_revenue"),
        *more,
    )


def payment_totals(payments: DataFrame) -> DataFrame:
    """Per order: total, most instalments, and the type of the largest single payment.

    Payments without a type or value cannot be the largest; equal values go to the
    alphabetically last type, so the result does not depend on row order.
    """
    ranked = F.when(
        F.col("payment_type").isNotNull() & F.col("payment_value").isNotNull(),
        F.struct("payment_value", "payment_type"),
    )
    return payments.groupBy("order_id").agg(
        F.sum("payment_value").cast(TOTAL).alias("payment_total"),
        F.max("payment_installments").alias("max_installments"),
        F.max(ranked)["payment_type"].alias("primary_payment_type"),
    )


def fct_orders(
    orders: DataFrame, items: DataFrame, payments: DataFrame, customers: DataFrame, r: Rules
) -> DataFrame:
    return orders_with_totals(orders, item_totals(items), payment_totals(payments), customers, r)


def orders_with_totals(
    orders: DataFrame, items: DataFrame, payments: DataFrame, customers: DataFrame, r: Rules
) -> DataFrame:
    """The order fact from totals per order; items may carry further columns."""
    items = items.select("order_id", "item_count", "item_revenue", "freight_revenue")
    people = customers.select("customer_id", "customer_unique_id", F.col("state").alias("customer_state"))
    joined = (
        orders.join(people, "customer_id", "left")
        .join(items, "order_id", "left")
        .join(payments, "order_id", "left")
    )
    gross = _zero("item_revenue", TOTAL) + _zero("freight_revenue", TOTAL)
    return joined.select(
        "order_id",
        "customer_id",
        "customer_unique_id",
        "customer_state",
        "order_status",
        "purchased_at",
        day("purchased_at").alias("order_date"),
        month_start("purchased_at").alias("order_month"),
        "delivered_at",
        "estimated_delivery_at",
        _zero("item_count", "bigint").alias("item_count"),
        _zero("item_revenue", TOTAL).alias("item_revenue"),
        _zero("freight_revenue", TOTAL).alias("freight_revenue"),
        gross.alias("gross_revenue"),
        "payment_total",
        "max_installments",
        "primary_payment_type",
        (earns_revenue(F.col("order_status"), r) & F.col("item_count").isNotNull()).alias("is_revenue_order"),
        in_window(F.col("purchased_at"), r).alias("in_analysis_window"),
    )


def window_revenue(orders_fact: DataFrame) -> DataFrame:
    """Revenue orders inside the analysis window."""
    return orders_fact.filter(F.col("is_revenue_order") & F.col("in_analysis_window"))


def seller_sales(items: DataFrame, orders: DataFrame, r: Rules) -> DataFrame:
    """Order lines that count as sales, one row per line.

    An order with a line is a revenue order whenever its status earns revenue, so
    staged orders suffice: both conditions reach their scan and the order totals
    need not be built.
    """
    sold = orders.filter(earns_revenue(F.col("order_status"), r) & in_window(F.col("purchased_at"), r))
    lines = items.select("order_id", "seller_id", "item_price")
    return lines.join(sold.select("order_id", "purchased_at"), "order_id")


def customer_sales(orders_fact: DataFrame) -> DataFrame:
    """The same shape as seller_sales with the person as the entity, one row per order."""
    return window_revenue(orders_fact).select(
        "order_id", "customer_unique_id", F.col("item_revenue").alias("item_price"), "purchased_at"
    )


def daily_states(orders_fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Revenue days with their totals. A day lies in one month, so days of a month can be replaced alone."""
    return window_revenue(orders_fact).groupBy(*keys, "order_month", "order_date").agg(
        F.count(F.lit(1)).alias("orders"),
        F.countDistinct("customer_unique_id").alias("customers"),
        F.sum("gross_revenue").alias("gross_revenue"),
        F.sum("item_revenue").alias("item_revenue"),
    )


def daily_from_states(states: DataFrame, r: Rules, keys: Sequence[str] = ()) -> DataFrame:
    """Daily totals without gaps, from the first revenue day to the end date."""
    zeros = {"orders": 0, "customers": 0, "gross_revenue": 0, "item_revenue": 0}
    return gap_fill(states.drop("order_month"), "order_date", "day", r.analysis_end, keys, zeros)


def fct_daily_revenue(orders_fact: DataFrame, r: Rules, keys: Sequence[str] = ()) -> DataFrame:
    return daily_from_states(daily_states(orders_fact, keys), r, keys)


def customer_states(orders_fact: DataFrame, by: Sequence[str] = ("order_month",)) -> DataFrame:
    """What a person's orders add up to, by month: parts that merge over months.

    Order ids are unique in the fact, so counting rows counts orders.
    """
    first = F.min(F.when(F.col("customer_state").isNotNull(), F.struct("purchased_at", "customer_state")))
    return window_revenue(orders_fact).groupBy("customer_unique_id", *by).agg(
        F.min("purchased_at").alias("first_order_at"),
        F.max("purchased_at").alias("last_order_at"),
        F.count("order_id").alias("order_count"),
        F.sum("gross_revenue").alias("lifetime_revenue"),
        first.alias("first_in"),
    )


def customers_from_states(states: DataFrame, r: Rules) -> DataFrame:
    """One row per person, merged from the states of all months."""
    return _customers(states.groupBy("customer_unique_id").agg(
        F.min("first_order_at").alias("first_order_at"),
        F.max("last_order_at").alias("last_order_at"),
        F.sum("order_count").alias("order_count"),
        F.sum("lifetime_revenue").alias("lifetime_revenue"),
        F.min("first_in").alias("first_in"),
    ), r)


def dim_customers(orders_fact: DataFrame, r: Rules) -> DataFrame:
    """One row per person, straight from the orders."""
    return _customers(customer_states(orders_fact, ()), r)


def _customers(people: DataFrame, r: Rules) -> DataFrame:
    return people.select(
        "customer_unique_id",
        "first_order_at",
        "last_order_at",
        month_start("first_order_at").alias("cohort_month"),
        "order_count",
        F.col("lifetime_revenue").cast("decimal(28,2)").alias("lifetime_revenue"),
        day_boundaries(F.col("last_order_at"), F.lit(r.analysis_end)).alias("recency_days"),
        (F.col("order_count") > 1).alias("is_repeat_customer"),
        F.col("first_in.customer_state").alias("first_state"),
    )


def active_months(sales: DataFrame, entity: str) -> DataFrame:
    """Entity x month, active months only: the base of all activity, churn and cohort results.

    An order has one purchase time, so it belongs to one month and orders add up over months.
    """
    return sales.groupBy(entity, month_start("purchased_at").alias("month")).agg(
        F.countDistinct("order_id").alias("orders"),
        F.sum("item_price").cast(TOTAL).alias("item_revenue"),
        F.min("purchased_at").alias("first_sale_at"),
        F.max("purchased_at").alias("last_sale_at"),
    )


def dim_sellers(sellers: DataFrame, months: DataFrame, deals: DataFrame, r: Rules) -> DataFrame:
    """Sellers with their activity and status; `months` comes from active_months."""
    activity = months.groupBy("seller_id").agg(
        F.min("first_sale_at").alias("first_sale_at"),
        F.max("last_sale_at").alias("last_sale_at"),
        F.sum("orders").alias("orders"),
        F.sum("item_revenue").alias("item_revenue"),
    )
    signed = deals.select("seller_id", "mql_id")
    idle = day_boundaries(F.col("last_sale_at"), F.lit(r.analysis_end))
    status = (
        F.when(F.col("last_sale_at").isNull(), "never_sold")
        .when(idle > r.churn_days, "churned")
        .otherwise("active")
    )
    return (
        sellers.select("seller_id", "state")
        .join(activity, "seller_id", "left")
        .join(signed, "seller_id", "left")
        .select(
            "seller_id",
            "state",
            "first_sale_at",
            "last_sale_at",
            _zero("orders", "bigint").alias("orders"),
            _zero("item_revenue", TOTAL).alias("item_revenue"),
            F.col("mql_id").isNotNull().alias("acquired_via_marketing_funnel"),
            idle.alias("days_since_last_sale"),
            status.alias("lifecycle_status"),
        )
    )


def activity_panel(months: DataFrame, entity: str, r: Rules) -> DataFrame:
    """Entity x every month from the first sale to the end month."""
    months = (
        months.select(entity, "month", "orders", "item_revenue")
        .filter(F.col("month") <= F.lit(r.end_month))
        .withColumn("cohort_month", F.min("month").over(Window.partitionBy(entity)))
    )
    zeros = {"orders": 0, "item_revenue": 0}
    panel = gap_fill(months, "month", "month", r.end_month, [entity], zeros, real="is_active")
    return panel.select(
        entity,
        "cohort_month",
        "month",
        month_boundaries("cohort_month", "month").alias("months_since_first_sale"),
        "orders",
        "item_revenue",
        "is_active",
    )


def fct_seller_monthly(months: DataFrame, r: Rules) -> DataFrame:
    return activity_panel(months, "seller_id", r)


def fct_lead_funnel(leads: DataFrame, deals: DataFrame, months: DataFrame, r: Rules) -> DataFrame:
    """One row per lead: won, activated (any sale), retained (sales in enough months).

    Only sellers named by a deal matter, so their months are picked first; when the deals
    are small enough to broadcast, Spark moves that filter below the aggregation and the
    join that make `months`, so other sellers' lines are dropped at the scan.
    """
    signed = deals.select("seller_id").filter(F.col("seller_id").isNotNull()).distinct()
    counted = F.col("month") <= F.lit(r.end_month)
    sellers = months.join(signed, "seller_id", "left_semi").groupBy("seller_id").agg(
        F.min("first_sale_at").alias("first_sale_at"),
        F.count(F.when(counted, 1)).alias("active_months"),
        F.sum(F.when(counted, F.col("item_revenue"))).alias("seller_item_revenue"),
    )
    deal = deals.select(
        "mql_id", "seller_id", "won_at", "business_segment", "lead_type", "business_type",
        F.lit(True).alias("_deal"),
    )
    sold_months = _zero("active_months", "bigint")
    won_day, sale_day = day("won_at"), day("first_sale_at")
    return leads.join(deal, "mql_id", "left").join(sellers, "seller_id", "left").select(
        "mql_id",
        "origin",
        "landing_page_id",
        "first_contact_date",
        month_start("first_contact_date").alias("lead_month"),
        "seller_id",
        "won_at",
        "business_segment",
        "lead_type",
        "business_type",
        "first_sale_at",
        sold_months.alias("active_months"),
        _zero("seller_item_revenue", TOTAL).alias("seller_item_revenue"),
        F.col("_deal").isNotNull().alias("is_won"),
        F.col("first_sale_at").isNotNull().alias("is_activated"),
        (sold_months >= r.retained_months).alias("is_retained"),
        day_boundaries(F.col("first_contact_date"), won_day).alias("days_to_close"),
        day_boundaries(won_day, sale_day).alias("days_won_to_first_sale"),
    )
