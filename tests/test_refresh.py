"""Refreshing single months against a full build."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from storepulse.plans import pipeline
from storepulse.plans.workspace import Workspace
from storepulse.sources.tpch import RULES, Source

MONTHS = [dt.date(1998, 3, 1), dt.date(2001, 7, 1)]


def only(raw, condition, keep=True):
    """Orders of some months with their items and payments; the other tables whole."""
    orders = raw["orders"].withColumn("_in", condition)
    orders = orders.filter("_in" if keep else "not _in").drop("_in")
    own = lambda name: raw[name].join(orders.select("order_id"), "order_id", "left_semi")
    return {**{n: raw[n] for n in raw}, "orders": orders, "order_items": own("order_items"), "order_payments": own("order_payments")}


@pytest.fixture(scope="module")
def raws(spark):
    """The tables before, and after some months got other orders, prices and customers."""
    before = dict(Source(spark, "/root/testdata/sf0.001").raw())
    month = F.trunc("order_purchase_timestamp", "month")
    touched = month.isin(MONTHS)
    after = dict(before)
    after["orders"] = before["orders"].filter(~touched | (F.col("order_id") % 5 > 0)).withColumn(
        "customer_id", F.when(touched & (F.col("order_id") % 3 == 0), F.lit(7).cast("bigint")).otherwise(F.col("customer_id")))
    in_months = before["orders"].filter(touched).select("order_id", F.lit(True).alias("t"))
    items = before["order_items"].join(in_months, "order_id", "left")
    after["order_items"] = items.withColumn("price", F.when(F.col("t"), F.col("price") + 10).otherwise(F.col("price"))).drop("t")
    return before, after, touched


@pytest.fixture(scope="module")
def built(spark, raws, tmp_path_factory):
    """A full build of the tables as they were; each test works on a copy of it."""
    folder = str(tmp_path_factory.mktemp("built"))
    return pipeline.build_models(spark, raws[0], RULES, folder)[0], folder


def test_refreshed_months_equal_a_full_build(spark, raws, built, tmp_path):
    _, after, touched = raws
    folder, whole = str(tmp_path / "refreshed"), str(tmp_path / "whole")
    shutil.copytree(built[1], folder)
    tables = pipeline.refresh_months(spark, only(after, touched), RULES, folder, MONTHS)
    _, full = pipeline.build_models(spark, after, RULES, whole)
    for name, partitions in pipeline.MART_TABLES:
        got, want = tables.get("marts", name), full.get("marts", name)
        assert sorted(got.dtypes) == sorted(want.dtypes), name
        columns = sorted(want.columns)
        a, b = (sorted(map(repr, df.select(*columns).collect())) for df in (got, want))
        assert a == b, name
        if partitions:
            # All other months are the files of the first build.
            old, new = tables.table("marts", name).current().parts
            assert len(new[1]) == len(MONTHS) and not set(new[1]) & set(old[1]) and len(old[1]) > 50
            files = tables.table("marts", name).folders()
            assert {d for d in os.listdir(files[-1]) if "=" in d} == set(new[1])


def test_a_month_that_lost_all_orders(spark, raws, built, tmp_path):
    before, _, touched = raws
    folder = str(tmp_path / "refreshed")
    shutil.copytree(built[1], folder)
    tables = pipeline.refresh_months(spark, only(before, F.lit(False)), RULES, folder, MONTHS)
    left = {r.order_month for r in tables.get("marts", "fct_orders").select("order_month").distinct().collect()}
    assert left and not left & set(MONTHS)
    full = Workspace(spark, only(before, touched, keep=False), RULES)
    for name in ("dim_customers", "fct_daily_revenue", "dim_sellers"):
        want = getattr(full, name)
        columns = sorted(want.columns)
        a, b = (sorted(map(repr, df.select(*columns).collect())) for df in (tables.get("marts", name), want))
        assert a == b, name


def test_rows_of_other_months_are_refused(spark, raws, built, tmp_path):
    folder = str(tmp_path / "refreshed")
    shutil.copytree(built[1], folder)
    with pytest.raises(ValueError, match="outside"):
        pipeline.refresh_months(spark, raws[0], RULES, folder, MONTHS[:1])


def test_merging_does_not_read_the_order_fact(spark, raws, built):
    plans = pipeline.StoredWorkspace(spark, raws[0], RULES)
    plans.daily_states, plans.customer_states = built[0].daily_states, built[0].customer_states
    for name in ("fct_daily_revenue", "dim_customers"):
        files = getattr(plans, name).inputFiles()
        assert files and all("_states/data/" in f for f in files)
