"""Every operator as a named query over a folder of benchmark tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType, ShortType

from storepulse import session
from storepulse.functions.calendar import holiday_flags
from storepulse.functions.lazy import LazyTables
from storepulse.operators import checks, forecast, funnel, marts, measures, quality, retention, staging, states
from storepulse.plans.workspace import AuditWorkspace, Workspace
from storepulse.sources.raw import row_counts
from storepulse.sources.tpch import RULES, Source

Query = Callable[[SparkSession, str], DataFrame]

BASE = forecast.BASELINES
# Models that plain SQL can repeat; the damped trend needs a search.
REPEATABLE = ("naive", "ma4", "reg_trend")
STATUS = ["order_status"]
# Parameters of single queries; the oracle text states the same numbers.
CHURN_YEAR = 2000
BY_STATUS_VOLUME = replace(RULES, volume_min_median=1.0)
FIXED_MULTIPLIER = 2.0


def plain(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Result form: money as double, counts as bigint, doubles optionally rounded."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (IntegerType, ShortType)):
            c = c.cast("bigint")
        elif f.dataType.typeName() == "double" and digits is not None:
            c = F.round(c, digits)
        cols.append(c.alias(f.name))
    return df.select(cols)


_QUERIES: dict[str, Callable[[Workspace], DataFrame]] = {}


def query(fn: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
    _QUERIES[fn.__name__] = fn
    return fn


def _register(name: str, build: Callable[[Workspace], DataFrame]) -> None:
    _QUERIES[name] = build


# --- sources and staging -------------------------------------------------------------

@query
def raw_row_counts(w):
    return row_counts(w.raw)


for _name in (
    "stg_orders", "stg_order_items", "stg_order_payments", "stg_customers", "stg_sellers",
    "stg_products", "stg_leads", "stg_closed_deals",
):
    def _staged(w: Workspace, name: str = _name) -> DataFrame:
        return plain(staging.stage_all(w.source.raw_text())[name])

    _register(_name, _staged)


# --- marts ---------------------------------------------------------------------------

@query
def fct_orders(w):
    return plain(w.fct_orders)


@query
def seller_sales(w):
    return plain(w.seller_sales)


@query
def fct_daily_revenue(w):
    return plain(w.fct_daily_revenue)


@query
def fct_daily_revenue_by_status(w):
    return plain(marts.fct_daily_revenue(w.fct_orders, RULES, STATUS))


@query
def dim_customers(w):
    return plain(w.dim_customers)


@query
def dim_sellers(w):
    return plain(w.dim_sellers)


@query
def fct_seller_monthly(w):
    return plain(w.fct_seller_monthly)


@query
def fct_customer_monthly(w):
    return plain(marts.activity_panel(w.customer_months, "customer_unique_id", RULES))


@query
def fct_lead_funnel(w):
    return plain(w.fct_lead_funnel)


@query
def dim_date(w):
    return plain(w.dim_date)


# --- data quality --------------------------------------------------------------------

@query
def dq_payment_reconciliation(w):
    return plain(w.dq_payment_reconciliation)


@query
def dq_order_lifecycle_anomalies(w):
    return plain(w.dq_order_lifecycle_anomalies)


@query
def dq_orphan_keys(w):
    return plain(w.dq_orphan_keys)


@query
def dq_possible_duplicate_orders(w):
    """Checkouts alike by person, month and value band: the benchmark's exact values never repeat in a day."""
    alike = w.fct_orders.withColumns({
        "order_date": F.col("order_month"), "gross_revenue": F.floor(F.col("gross_revenue") / 50_000) * 50_000,
    })
    return plain(quality.dq_possible_duplicate_orders(alike))


@query
def dq_possible_duplicates_by_day(w):
    return plain(quality.dq_possible_duplicate_orders(w.fct_orders, ["customer_unique_id", "order_date"]))


@query
def dq_duplicate_members_by_day(w):
    return plain(quality.duplicate_members(w.fct_orders, ["customer_unique_id", "order_date"]))


@query
def dq_volume_anomalies(w):
    return plain(w.dq_volume_anomalies)


@query
def dq_volume_anomalies_by_status(w):
    return plain(quality.dq_volume_anomalies(w.staged["stg_orders"], BY_STATUS_VOLUME, keys=STATUS))


@query
def dq_summary(w):
    return plain(w.audit.dq_summary)


@query
def dq_findings(w):
    return plain(w.audit.dq_findings)


@query
def dq_daily_volume(w):
    return plain(quality.dq_daily_volume(w.staged["stg_orders"], RULES.volume_report_since))


@query
def dq_base_count(w):
    return plain(quality.dq_base_count(w.fct_orders))


# --- data tests ----------------------------------------------------------------------

@query
def check_unique(w):
    return plain(checks.check_unique(w.staged["stg_order_payments"], "order_id"))


@query
def check_not_null(w):
    return plain(checks.check_not_null(w.staged["stg_products"], "category_pt"))


@query
def check_accepted_values(w):
    return plain(checks.check_accepted_values(w.staged["stg_leads"], "origin", ["email", "social", "unknown"]))


@query
def check_relationships(w):
    return plain(checks.check_relationships(
        w.staged["stg_closed_deals"], "seller_id", w.staged["stg_sellers"], "seller_id"))


@query
def check_unique_combination(w):
    return plain(checks.check_unique_combination(w.staged["stg_order_items"], ["order_id", "order_item_id"]))


@query
def check_daily_reconciles(w):
    return plain(checks.check_daily_reconciles(w.fct_daily_revenue, w.fct_orders, RULES), 2)


@query
def check_funnel_monotonic(w):
    """Deals count as won only when closed within 30 days, so later ones skip a stage."""
    won = F.col("is_won") & (F.col("days_to_close") <= 30)
    return plain(checks.check_funnel_monotonic(w.fct_lead_funnel.withColumn("is_won", won)))


@query
def check_payment_recon_rate(w):
    return plain(checks.check_payment_recon_rate(w.fct_orders, RULES))


@query
def run_checks(w):
    return plain(w.audit.run_checks())


@query
def star_relations(w):
    return plain(w.audit.star_relations())


# --- forecasting ---------------------------------------------------------------------

@query
def weekly_revenue(w):
    return plain(measures.weekly_revenue(w.fct_daily_revenue, RULES))


def _weekly_by_status(w: Workspace) -> DataFrame:
    daily = marts.fct_daily_revenue(w.fct_orders, RULES, STATUS)
    return forecast.weekly_series(daily, RULES, "gross_revenue", STATUS)


@query
def weekly_revenue_by_status(w):
    return plain(_weekly_by_status(w))


@query
def holiday_flags_weekly(w):
    return plain(holiday_flags(w.weekly.select("week")))


for _model in forecast.MODELS:
    def _point(w: Workspace, model: str = _model) -> DataFrame:
        points = forecast.forecasts(w.weekly, [model], RULES.forecast_weeks, RULES)
        return plain(points.drop("resid_sd"), 4 if model in BASE else 0)

    _register(f"forecast_{_model}", _point)


@query
def residual_interval(w):
    points = forecast.forecasts(w.weekly, BASE, RULES.forecast_weeks, RULES)
    return plain(forecast.residual_interval(points, RULES), 4)


@query
def rolling_origin_folds(w):
    return plain(forecast.rolling_origin_folds(w.weekly, RULES).drop("positive"))


@query
def forecast_backtest(w):
    return plain(forecast.rounded_summary(forecast.backtest(w.weekly, REPEATABLE, RULES)[0]))


@query
def forecast_backtest_by_status(w):
    summary, _ = forecast.backtest(_weekly_by_status(w), BASE, RULES, STATUS)
    return plain(forecast.rounded_summary(summary, STATUS))


@query
def forecast_backtest_all_models(w):
    return plain(forecast.rounded_summary(forecast.backtest(w.weekly, forecast.MODELS, RULES)[0]))


@query
def backtest_step_errors(w):
    errors = forecast.backtest_errors(w.weekly, REPEATABLE, RULES).drop("week")
    return errors.withColumns({"forecast": F.round("forecast", 0), "pct_err": F.round("pct_err", 6)}).transform(plain)


@query
def select_best_model(w):
    return plain(forecast.select_best_model(forecast.backtest(w.weekly, REPEATABLE, RULES)[0]))


@query
def select_best_model_by_status(w):
    summary, _ = forecast.backtest(_weekly_by_status(w), BASE, RULES, STATUS)
    return plain(forecast.select_best_model(summary, STATUS))


@query
def weekly_forecast(w):
    return plain(forecast.weekly_forecast(w.weekly, RULES, REPEATABLE))


@query
def weekly_forecast_all_models(w):
    return plain(forecast.weekly_forecast(w.weekly, RULES))


@query
def calibrated_interval(w):
    summary, _ = forecast.backtest(w.weekly, REPEATABLE, RULES)
    points = forecast.forecasts(w.weekly, REPEATABLE, RULES.forecast_weeks, RULES).drop("resid_sd")
    return plain(forecast.calibrated_interval(points, summary, RULES), 0)


@query
def holiday_multiplier(w):
    return plain(forecast.holiday_multiplier(w.weekly), 6)


def _plan(w: Workspace, models, multiplier: DataFrame | None = None) -> DataFrame:
    return forecast.monthly_plan(forecast.best_forecast(w.weekly, RULES, models), multiplier)


@query
def monthly_plan(w):
    """Models that SQL can repeat, with a given multiplier."""
    return plain(_plan(w, REPEATABLE, w.spark.range(1).select(F.lit(FIXED_MULTIPLIER).alias("multiplier"))))


@query
def monthly_plan_fitted(w):
    """All models and the estimated multiplier: the full planning job."""
    return plain(_plan(w, forecast.MODELS))


# --- funnel --------------------------------------------------------------------------

def _mature(w: Workspace) -> DataFrame:
    return funnel.mature_leads(w.fct_lead_funnel, RULES)


@query
def mature_leads(w):
    return plain(_mature(w))


@query
def funnel_overall(w):
    return plain(funnel.funnel_overall(_mature(w)))


@query
def funnel_by_origin(w):
    return plain(funnel.funnel_by(_mature(w), RULES), 6)


@query
def win_rate_ranked(w):
    return plain(funnel.win_rate_ranked(funnel.funnel_by(_mature(w), RULES), RULES), 6)


@query
def funnel_by_segment(w):
    return plain(funnel.funnel_by_segment(w.fct_lead_funnel, RULES))


@query
def funnel_timing(w):
    return plain(funnel.funnel_timing(w.fct_lead_funnel), 6)


@query
def days_to_close_histogram(w):
    return plain(funnel.days_to_close_histogram(w.fct_lead_funnel, RULES), 6)


# --- retention -----------------------------------------------------------------------

def _customer_cohorts(w: Workspace) -> DataFrame:
    return retention.cohort_retention(
        retention.customer_months(w.fct_orders), "customer_unique_id", RULES.customer_cohort_min)


def _seller_months(w: Workspace) -> DataFrame:
    return w.seller_months.filter(F.col("month") <= F.lit(RULES.end_month))


@query
def customer_cohort_retention(w):
    return plain(_customer_cohorts(w), 6)


@query
def customer_cohort_matrix(w):
    return plain(retention.cohort_matrix(_customer_cohorts(w), RULES.cohort_ages, 2))


@query
def seller_cohort_retention(w):
    return plain(retention.cohort_retention(_seller_months(w), "seller_id", RULES.seller_cohort_min), 6)


@query
def seller_cohort_matrix(w):
    cohorts = retention.cohort_retention(_seller_months(w), "seller_id", RULES.seller_cohort_min)
    return plain(retention.cohort_matrix(cohorts, RULES.cohort_ages, 1))


@query
def second_order_gap(w):
    return plain(retention.second_order_gap(w.fct_orders))


@query
def customer_retention_summary(w):
    return plain(retention.customer_retention_summary(w.fct_orders, RULES))


@query
def rfm_customer_scores(w):
    return plain(retention.rfm_scores(w.dim_customers))


@query
def rfm_segments(w):
    return plain(retention.rfm_segments(retention.rfm_scores(w.dim_customers)))


@query
def seller_monthly_churn(w):
    return plain(retention.monthly_churn(_seller_months(w), "seller_id", RULES))


def _customer_churn(w: Workspace) -> DataFrame:
    return retention.monthly_churn(retention.customer_months(w.fct_orders), "customer_unique_id", RULES)


@query
def customer_monthly_churn(w):
    return plain(_customer_churn(w))


@query
def avg_churn_for_year(w):
    return plain(retention.avg_churn(_customer_churn(w), CHURN_YEAR), 6)


@query
def seller_lifecycle_status(w):
    return plain(retention.lifecycle_status(w.dim_sellers), 6)


@query
def seller_churn_by_size(w):
    return plain(retention.churn_by_size(w.dim_sellers, RULES))


# Ten days after the first order some sellers have not sold yet, some were idle for days.
EARLY = replace(RULES, analysis_end=dt.date(1995, 1, 8), churn_days=2)


def _early_sellers(w: Workspace) -> DataFrame:
    return Workspace(w.spark, w.raw, EARLY).dim_sellers


@query
def early_lifecycle_status(w):
    return plain(retention.lifecycle_status(_early_sellers(w)), 6)


@query
def early_churn_by_size(w):
    return plain(retention.churn_by_size(_early_sellers(w), EARLY))


@query
def customer_churn_by_size(w):
    status = retention.entity_status(w.customer_months, "customer_unique_id", RULES)
    return plain(retention.churn_by_size(status, RULES))


# --- measures ------------------------------------------------------------------------

def _star(w: Workspace) -> LazyTables:
    """Star tables as exported: order facts of the analysis window only."""
    return LazyTables({
        "fct_orders": lambda: w.fct_orders.filter("in_analysis_window"),
        "fct_lead_funnel": lambda: w.fct_lead_funnel,
        "dim_customers": lambda: w.dim_customers,
        "fct_seller_monthly": lambda: w.fct_seller_monthly,
    })


@query
def gross_revenue(w):
    return plain(measures.measure("gross_revenue", _star(w), ["order_month"]))


@query
def revenue_orders(w):
    return plain(measures.measure("revenue_orders", _star(w), ["order_month"]))


@query
def average_order_value(w):
    return plain(measures.measure("average_order_value", _star(w), ["customer_state"]), 6)


@query
def revenue_mom(w):
    return plain(measures.revenue_change(_star(w)["fct_orders"], 1), 6)


@query
def revenue_yoy(w):
    return plain(measures.revenue_change(_star(w)["fct_orders"], 12), 6)


@query
def revenue_mom_by_state(w):
    return plain(measures.revenue_change(_star(w)["fct_orders"], 1, ["customer_state"]), 6)


@query
def funnel_counts(w):
    return plain(measures.measures(["mqls", "won_deals", "activated_sellers"], _star(w), ["origin"]))


@query
def lead_to_win_rate(w):
    return plain(measures.measure("lead_to_win_rate", _star(w), ["origin"]), 6)


@query
def win_to_activation_rate(w):
    return plain(measures.measure("win_to_activation_rate", _star(w), ["business_segment"]), 6)


@query
def median_days_to_close(w):
    return plain(measures.measure("median_days_to_close", _star(w)), 6)


@query
def repeat_customer_rate(w):
    return plain(measures.measures(["customers", "repeat_customer_rate"], _star(w), ["cohort_month"]), 6)


@query
def active_sellers(w):
    return plain(measures.measure("active_sellers", _star(w), ["month"]))


@query
def seller_churn_setwise(w):
    return plain(measures.churn_setwise(_seller_months(w), "seller_id", RULES), 6)


@query
def customer_churn_setwise(w):
    months = retention.customer_months(w.fct_orders)
    return plain(measures.churn_setwise(months, "customer_unique_id", RULES), 6)


@query
def revenue_vs_forecast_weekly(w):
    return plain(measures.actual_vs_forecast(w.weekly, forecast.weekly_forecast(w.weekly, RULES, REPEATABLE)))


@query
def revenue_by_slicer(w):
    names = ["gross_revenue", "revenue_orders", "average_order_value"]
    return plain(measures.measures(names, _star(w), ["customer_state", "primary_payment_type"]), 6)


REVENUE_GRAINS = ([], ["customer_state"], ["primary_payment_type"], ["order_month"], ["customer_state", "primary_payment_type"])


@query
def revenue_by_grains(w):
    """Total and four cuts of every order measure from one scan of the fact."""
    names = ["gross_revenue", "revenue_orders", "average_order_value", "buyers", "median_order_value"]
    return plain(states.measures_by_grains(names, _star(w), REVENUE_GRAINS), 6)


@query
def funnel_by_grains(w):
    names = ["mqls", "won_deals", "activated_sellers", "lead_to_win_rate", "win_to_activation_rate", "median_days_to_close"]
    return plain(states.measures_by_grains(names, _star(w), [[], ["origin"], ["business_segment"]]), 6)


@query
def customers_by_grains(w):
    names = ["customers", "repeat_customer_rate"]
    return plain(states.measures_by_grains(names, _star(w), [[], ["cohort_month"]]), 6)


@query
def active_sellers_by_grains(w):
    return plain(states.measures_by_grains(["active_sellers"], _star(w), [[], ["month"]]))


class BenchmarkWorkspace(Workspace):
    """Workspace over a folder of benchmark tables, with the rules for that data."""

    def __init__(self, spark: SparkSession, folder: str):
        self.source = Source(spark, folder)
        super().__init__(spark, self.source.raw(), RULES)

    @cached_property
    def audit(self) -> AuditWorkspace:
        return AuditWorkspace(self.spark, self.raw, self.rules)


def queries() -> dict[str, Query]:
    def runner(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(BenchmarkWorkspace(session.configure(spark), folder))

        return run

    return {name: runner(build) for name, build in _QUERIES.items()}
