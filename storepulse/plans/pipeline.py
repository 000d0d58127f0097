"""The whole job: raw tables to staging views, mart and quality tables, reports and export."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.functions.calendar import date_dimension
from storepulse.functions.lazy import LazyTables
from storepulse.operators import forecast, funnel, measures, quality, retention
from storepulse.plans.workspace import StoredWorkspace, Workspace
from storepulse.rules import Rules
from storepulse.sources.sinks import Tables, export_star, write_report

# Tables in build order; each starts from the files of those before it. The order fact and the
# states are split by month, so that window and month filters skip whole files and a month can
# be replaced alone.
MART_TABLES = (
    ("fct_orders", ("order_month",)),
    ("daily_states", ("order_month",)),
    ("customer_states", ("order_month",)),
    ("seller_months", ("month",)),
    ("customer_months", ("month",)),
    ("fct_daily_revenue", ()),
    ("dim_customers", ()),
    ("dim_sellers", ()),
    ("fct_seller_monthly", ()),
    ("fct_lead_funnel", ()),
    ("dim_date", ()),
)
# Tables that are merged from states and dimensions, without the order fact.
MERGED = ("fct_daily_revenue", "dim_customers", "dim_sellers", "fct_seller_monthly", "fct_lead_funnel", "dim_date")
QUALITY_TABLES = (
    "dq_payment_reconciliation", "dq_order_lifecycle_anomalies", "dq_orphan_keys",
    "dq_possible_duplicate_orders", "dq_volume_anomalies", "dq_summary", "dq_findings",
)


def build_models(spark: SparkSession, raw: Mapping[str, DataFrame], rules: Rules, folder: str) -> tuple[Workspace, Tables]:
    """Register the staging views and write the mart and quality tables.

    Every saved table replaces its lazy plan in the workspace, so nothing is computed
    twice and a lost executor costs at most the table being written.
    """
    work, tables = StoredWorkspace(spark, raw, rules), Tables(spark, folder)
    for name, df in work.staged.items():
        tables.view("staging", name, df)
    for name, partitions in MART_TABLES:
        setattr(work, name, tables.save("marts", name, getattr(work, name), partitions))
    for name in QUALITY_TABLES:
        setattr(work, name, tables.save("data_quality", name, getattr(work, name)))
    return work, tables


def refresh_months(
    spark: SparkSession, raw: Mapping[str, DataFrame], rules: Rules, folder: str, months: Sequence[dt.date]
) -> Tables:
    """Replace whole months of the order tables and merge the marts anew.

    `raw` holds all orders of the given months with their items and payments, and none of
    other months; its other tables are complete. The months' partitions of the order fact
    and of the states are replaced, all others are shared with the version before, and the
    merged tables are rebuilt from the states. An order that moves to another month needs
    both months. Quality tables and reports are not touched.
    """
    work, tables = StoredWorkspace(spark, raw, rules), Tables(spark, folder)
    for name, partitions in MART_TABLES:
        if partitions:
            column, = partitions
            changed = tables.replace_partitions("marts", name, getattr(work, name), [{column: m} for m in months])
            # The states of the months come from their new part of the fact alone.
            here = changed.filter(F.col(column).isin(list(months))) if name == "fct_orders" else changed
            setattr(work, name, here)
    fact = tables.get("marts", "fct_orders")
    work.dim_date = date_dimension(fact.agg(F.min("order_month").alias("start"), F.last_day(F.max("order_month")).alias("end")))
    for name in MERGED:
        setattr(work, name, tables.save("marts", name, getattr(work, name)))
    return tables


def analysis_reports(work: Workspace) -> LazyTables:
    """The analysis results by report name."""
    r = work.rules
    best = _once(lambda: forecast.best_forecast(work.weekly, r))
    mature = _once(lambda: funnel.mature_leads(work.fct_lead_funnel, r))
    cohorts = _once(lambda: retention.cohort_retention(
        work.customer_months, "customer_unique_id", r.customer_cohort_min))
    scores = _once(lambda: retention.rfm_scores(work.dim_customers))
    seller_months = _once(lambda: work.seller_months.filter(F.col("month") <= F.lit(r.end_month)))
    return LazyTables({
        "forecast_backtest": lambda: forecast.rounded_summary(
            forecast.backtest(work.weekly, forecast.MODELS, r)[0]).orderBy("wape_pct"),
        "revenue_forecast_weekly": lambda: best().select("week", "forecast", "lower_80", "upper_80").orderBy("week"),
        "revenue_plan_monthly": lambda: forecast.monthly_plan(best()).orderBy("month"),
        "funnel_overall": lambda: funnel.funnel_overall(mature()).orderBy("position"),
        "funnel_by_origin": lambda: funnel.rounded_rates(funnel.funnel_by(mature(), r)).orderBy(F.desc("mqls"), "origin"),
        "funnel_win_rate": lambda: funnel.win_rate_ranked(funnel.funnel_by(mature(), r), r),
        "funnel_by_segment": lambda: funnel.funnel_by_segment(work.fct_lead_funnel, r),
        "funnel_timing": lambda: funnel.funnel_timing(work.fct_lead_funnel),
        "days_to_close_histogram": lambda: funnel.days_to_close_histogram(work.fct_lead_funnel, r).orderBy("bin"),
        "customer_cohort_retention_pct": lambda: retention.cohort_matrix(
            cohorts(), r.cohort_ages, 2).orderBy("cohort_month"),
        "customer_retention_summary": lambda: retention.customer_retention_summary(work.fct_orders, r),
        "rfm_customer_scores": lambda: scores().select("customer_unique_id", "R", "F", "M", "segment"),
        "rfm_segments": lambda: retention.rfm_segments(scores()),
        "seller_monthly_churn": lambda: retention.monthly_churn(seller_months(), "seller_id", r).orderBy("month"),
        "seller_cohort_retention_pct": lambda: retention.cohort_matrix(
            retention.cohort_retention(seller_months(), "seller_id", r.seller_cohort_min), r.cohort_ages, 1,
        ).orderBy("cohort_month"),
        "seller_lifecycle_status": lambda: retention.lifecycle_status(work.dim_sellers).orderBy("lifecycle_status"),
        "seller_churn_by_size": lambda: retention.churn_by_size(work.dim_sellers, r),
        "revenue_vs_forecast_weekly": lambda: measures.actual_vs_forecast(work.weekly, best()).orderBy("week"),
        "data_quality_findings": lambda: work.dq_findings,
        "daily_order_volume": lambda: quality.dq_daily_volume(
            work.staged["stg_orders"], r.volume_report_since).orderBy("order_date"),
        "data_tests": work.run_checks,
        "star_relations": work.star_relations,
    })


# Reports with one row per person: written as many files, never through one task.
LARGE_REPORTS = {"rfm_customer_scores"}


def _once(build):
    made: list[DataFrame] = []

    def get() -> DataFrame:
        if not made:
            made.append(build())
        return made[0]

    return get


def build_all(
    spark: SparkSession, raw: Mapping[str, DataFrame], rules: Rules, folder: str, export_to: str | None = None
) -> Tables:
    """Models, reports (CSV below `folder`/reports) and, when asked for, the star export."""
    work, tables = build_models(spark, raw, rules, folder)
    for name, df in analysis_reports(work).items():
        write_report(df, tables.path("reports", name), single_file=name not in LARGE_REPORTS)
    if export_to:
        export_star(work.tables(), export_to)
    return tables
