import datetime as dt
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from storepulse.plans import pipeline
from storepulse.plans.workspace import Workspace
from storepulse.sources import sinks
from storepulse.sources.tpch import RULES, Source


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("job"))
    raw = Source(spark, "/root/testdata/sf0.001").raw()
    tables = pipeline.build_all(spark, raw, RULES, folder, export_to=folder + "/export")
    return tables, folder


def test_every_layer_is_there(built):
    tables, folder = built
    for name, _ in pipeline.MART_TABLES:
        assert tables.get("marts", name).count() > 0
    for name in pipeline.QUALITY_TABLES:
        assert tables.get("data_quality", name).columns
    assert tables.get("staging", "stg_orders").count() == tables.get("marts", "fct_orders").count()
    data, = tables.table("marts", "fct_orders").folders()
    assert any(d.startswith("order_month=") for d in os.listdir(data))


def test_reports(spark, built):
    tables, folder = built
    names = set(os.listdir(folder + "/reports"))
    assert {"forecast_backtest", "revenue_forecast_weekly", "revenue_plan_monthly", "funnel_overall", "rfm_segments",
            "seller_monthly_churn", "data_quality_findings", "data_tests"} <= names
    tests = spark.read.option("header", True).csv(folder + "/reports/data_tests")
    assert tests.count() == 30
    relations = spark.read.option("header", True).csv(folder + "/reports/star_relations")
    assert relations.count() == len(sinks.STAR_RELATIONS)
    assert {r.status for r in relations.filter("severity = 'error'").collect()} == {"pass"}
    segments = spark.read.option("header", True).option("inferSchema", True).csv(folder + "/reports/rfm_segments")
    assert segments.agg({"customers": "sum"}).first()[0] == tables.get("marts", "dim_customers").count()


def test_summary_counts_match_the_tables(built):
    tables, _ = built
    summary = {(r.check_group, r.issue_type): r.records for r in tables.get("data_quality", "dq_summary").collect()}
    for group, name in (("payment_reconciliation", "dq_payment_reconciliation"),
                        ("order_lifecycle", "dq_order_lifecycle_anomalies"),
                        ("referential_integrity", "dq_orphan_keys"), ("volume", "dq_volume_anomalies")):
        total = sum(n for (g, _), n in summary.items() if g == group)
        assert total == tables.get("data_quality", name).count()


def test_a_new_session_reads_every_table(spark, built):
    _, folder = built
    later = sinks.Tables(spark.newSession(), folder)
    for name, _ in pipeline.MART_TABLES:
        assert later.get("marts", name).count() > 0
    for name in pipeline.QUALITY_TABLES:
        assert later.get("data_quality", name).columns


# Published columns of the exported findings and of the customer scores.
FINDINGS = ["check_group", "issue_type", "records"]
SCORES = ["customer_unique_id", "R", "F", "M", "segment"]


def test_star_export_and_relations(spark, built):
    tables, folder = built
    star = {n: spark.read.option("header", True).csv(f"{folder}/export/{n}") for n in sinks.STAR_TABLES}
    assert star["fct_orders"].count() == tables.get("marts", "fct_orders").filter("in_analysis_window").count()
    for child, key, parent, parent_key in sinks.STAR_RELATIONS:
        keys = star[child].select(key).filter(f"{key} is not null").alias("c")
        orphans = keys.join(star[parent].alias("p"), F.col(f"c.{key}") == F.col(f"p.{parent_key}"), "left_anti")
        if child != "fct_lead_funnel":  # a lead's seller may never have been listed
            assert orphans.count() == 0, (child, key)
    assert star["dq_findings"].columns == FINDINGS
    scores = spark.read.option("header", True).csv(folder + "/reports/rfm_customer_scores")
    assert scores.columns == SCORES
    wide = spark.read.option("header", True).csv(folder + "/reports/customer_cohort_retention_pct")
    assert wide.columns == ["cohort_month", *map(str, RULES.cohort_ages)]


def test_calendar_covers_orders_before_the_first_forecast_week(spark):
    raw = Source(spark, "/root/testdata/sf0.001").raw()
    late = replace(RULES, week_start_from=dt.date(1998, 1, 5))
    work = Workspace(spark, raw, late)
    missing = work.fct_orders.join(work.dim_date, F.col("order_date") == F.col("date"), "left_anti")
    assert missing.count() == 0
