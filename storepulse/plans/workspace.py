"""Lazy model tables over one set of raw tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.functions.calendar import date_dimension, month_start
from storepulse.functions.lazy import LazyTables
from storepulse.functions.shared import once
from storepulse.operators import marts, quality, staging
from storepulse.operators.checks import Profile, References, run_checks, standard_checks
from storepulse.operators.forecast import weekly_series
from storepulse.operators.quality import issue_counts
from storepulse.rules import Rules
from storepulse.sources import sinks


class Workspace:
    """Builds each model on first use. Nothing runs until a result is read; frames are
    shared, so Spark reuses the exchanges that several parts of one plan have in common."""

    def __init__(self, spark: SparkSession, raw: Mapping[str, DataFrame], rules: Rules):
        self.spark = spark
        self.raw = raw
        self.rules = rules

    @cached_property
    def staged(self) -> LazyTables:
        return staging.stage_all(self.raw)

    @cached_property
    def fct_orders(self) -> DataFrame:
        s = self.staged
        return marts.fct_orders(
            s["stg_orders"], s["stg_order_items"], s["stg_order_payments"], s["stg_customers"], self.rules
        )

    @cached_property
    def seller_sales(self) -> DataFrame:
        return marts.seller_sales(self.staged["stg_order_items"], self.staged["stg_orders"], self.rules)

    @cached_property
    def customer_sales(self) -> DataFrame:
        return marts.customer_sales(self.fct_orders)

    @cached_property
    def seller_months(self) -> DataFrame:
        return marts.active_months(self.seller_sales, "seller_id")

    @cached_property
    def customer_months(self) -> DataFrame:
        return marts.active_months(self.customer_sales, "customer_unique_id")

    @cached_property
    def fct_daily_revenue(self) -> DataFrame:
        return marts.fct_daily_revenue(self.fct_orders, self.rules)

    @cached_property
    def daily_states(self) -> DataFrame:
        return marts.daily_states(self.fct_orders)

    @cached_property
    def customer_states(self) -> DataFrame:
        return marts.customer_states(self.fct_orders)

    @cached_property
    def dim_customers(self) -> DataFrame:
        return marts.dim_customers(self.fct_orders, self.rules)

    @cached_property
    def dim_sellers(self) -> DataFrame:
        s = self.staged
        return marts.dim_sellers(s["stg_sellers"], self.seller_months, s["stg_closed_deals"], self.rules)

    @cached_property
    def fct_seller_monthly(self) -> DataFrame:
        return marts.fct_seller_monthly(self.seller_months, self.rules)

    @cached_property
    def fct_lead_funnel(self) -> DataFrame:
        s = self.staged
        return marts.fct_lead_funnel(s["stg_leads"], s["stg_closed_deals"], self.seller_months, self.rules)

    @cached_property
    def dim_date(self) -> DataFrame:
        """Calendar of whole months around every order, so that each one has its day."""
        bought = self.staged["stg_orders"]
        return date_dimension(bought.agg(
            month_start(F.min("purchased_at")).alias("start"), F.last_day(F.max("purchased_at").cast("date")).alias("end")
        ))

    @cached_property
    def dq_payment_reconciliation(self) -> DataFrame:
        return quality.dq_payment_reconciliation(self.fct_orders, self.rules)

    @cached_property
    def dq_order_lifecycle_anomalies(self) -> DataFrame:
        return quality.dq_order_lifecycle_anomalies(self.staged["stg_orders"])

    @cached_property
    def dq_orphan_keys(self) -> DataFrame:
        s = self.staged
        return quality.dq_orphan_keys(
            s["stg_order_items"], s["stg_sellers"], s["stg_products"], s["stg_closed_deals"], s["stg_leads"]
        )

    @cached_property
    def dq_possible_duplicate_orders(self) -> DataFrame:
        return quality.dq_possible_duplicate_orders(self.fct_orders)

    @cached_property
    def dq_volume_anomalies(self) -> DataFrame:
        return quality.dq_volume_anomalies(self.staged["stg_orders"], self.rules)

    @cached_property
    def dq_summary(self) -> DataFrame:
        return quality.dq_summary(
            self.dq_payment_reconciliation, self.dq_order_lifecycle_anomalies, self.dq_orphan_keys,
            quality.duplicate_groups(self.fct_orders), self.dq_volume_anomalies,
        )

    @cached_property
    def dq_findings(self) -> DataFrame:
        return quality.dq_findings(
            self.dq_summary, self.dq_payment_reconciliation, quality.explanations(self.spark, self.rules)
        )

    @property
    def profiles(self) -> dict[str, list[Profile]]:
        """Frames that answer tests of larger tables; none where tables are built one by one."""
        return {}

    def run_checks(self) -> DataFrame:
        return run_checks(self.tables(), standard_checks(self.rules), self.profiles)

    def star_relations(self) -> DataFrame:
        """The relations of the exported star, each with the number of rows without a parent."""
        star = sinks.star_schema(self.tables())
        return run_checks(star, [
            References(child, key, parent, parent_key, "warn" if (child, key) in sinks.LOOSE_RELATIONS else "error")
            for child, key, parent, parent_key in sinks.STAR_RELATIONS
        ])

    @cached_property
    def weekly(self) -> DataFrame:
        return weekly_series(self.fct_daily_revenue, self.rules)

    def tables(self) -> LazyTables:
        """All model tables by name, built when first used."""
        names = (
            "fct_orders", "fct_daily_revenue", "dim_customers", "dim_sellers", "fct_seller_monthly",
            "fct_lead_funnel", "dim_date", "dq_payment_reconciliation", "dq_order_lifecycle_anomalies",
            "dq_orphan_keys", "dq_possible_duplicate_orders", "dq_volume_anomalies", "dq_summary", "dq_findings",
        )
        models = {name: partial(getattr, self, name) for name in names}
        staged = {name: partial(self.staged.__getitem__, name) for name in self.staged}
        return LazyTables({**staged, **models})


class StoredWorkspace(Workspace):
    """The same models for jobs that save tables as they go: what can be merged from the stored
    states of months is, instead of from the orders."""

    @cached_property
    def fct_daily_revenue(self) -> DataFrame:
        return marts.daily_from_states(self.daily_states, self.rules)

    @cached_property
    def dim_customers(self) -> DataFrame:
        return marts.customers_from_states(self.customer_states, self.rules)


# Columns of the order fact that checks, summaries and the tables behind them read.
AUDITED = (
    "order_id", "customer_unique_id", "customer_state", "order_status", "purchased_at", "order_date", "order_month",
    "item_count", "item_revenue", "gross_revenue", "payment_total", "is_revenue_order", "in_analysis_window",
)


class AuditWorkspace(Workspace):
    """The same models for plans that read many of them at once, as checks and summaries do.

    Items are read once for the order fact and their own checks (`item_orders`, one row per
    order); the order fact and the sales per seller and month are computed once per plan.
    """

    @cached_property
    def item_orders(self) -> DataFrame:
        s = self.staged
        return once(quality.item_profile(s["stg_order_items"], s["stg_sellers"], s["stg_products"]))

    @cached_property
    def fct_orders(self) -> DataFrame:
        s = self.staged
        payments = marts.payment_totals(s["stg_order_payments"])
        fact = marts.orders_with_totals(s["stg_orders"], self.item_orders, payments, s["stg_customers"], self.rules)
        return once(fact, *AUDITED)

    @cached_property
    def seller_months(self) -> DataFrame:
        return once(marts.active_months(self.seller_sales, "seller_id"))

    @cached_property
    def dq_summary(self) -> DataFrame:
        s = self.staged
        orphans = issue_counts(quality.other_orphans(
            s["stg_sellers"], s["stg_products"], s["stg_closed_deals"], s["stg_leads"]))
        return quality.summary_of(
            issue_counts(self.dq_payment_reconciliation), issue_counts(self.dq_order_lifecycle_anomalies),
            orphans.unionByName(quality.item_orphan_counts(self.item_orders)),
            quality.duplicate_groups(self.fct_orders), issue_counts(self.dq_volume_anomalies),
        )

    @property
    def profiles(self) -> dict[str, list[Profile]]:
        return {"stg_order_items": [Profile(self.item_orders, "order_id", "item_count", {"item_price": "no_price"})]}
