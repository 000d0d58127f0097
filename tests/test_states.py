"""Measures from merged states against direct ones, and the errors of sketches."""

import numpy as np
import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from storepulse.operators import measures, states
from storepulse.plans.registry import BenchmarkWorkspace, _star

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def star(spark):
    return _star(BenchmarkWorkspace(spark, FOLDER))


@pytest.mark.parametrize("name, by", [
    ("gross_revenue", "customer_state"), ("revenue_orders", "primary_payment_type"), ("average_order_value", "order_month"),
    ("lead_to_win_rate", "origin"), ("win_to_activation_rate", "business_segment"), ("median_days_to_close", "origin"),
    ("repeat_customer_rate", "cohort_month"), ("customers", "cohort_month"), ("active_sellers", "month"),
])
def test_states_give_the_direct_measures(star, name, by):
    got = states.measures_by_grains([name], star, [[], [by]])
    direct = {r[0]: r[1] for r in measures.measure(name, star, [by]).collect()}
    assert {r[by]: r[name] for r in got.filter(f"grain = '{by}'").collect()} == pytest.approx(direct)
    total, = got.filter("grain = ''").collect()
    assert total[name] == pytest.approx(measures.measure(name, star).first()[0])


def test_one_scan_for_all_grains(star):
    table = star["fct_orders"]
    names = ["gross_revenue", "average_order_value", "buyers", "median_order_value"]
    out = states.measures_by_grains(names, {"fct_orders": table}, [[], ["customer_state"], ["order_month"], ["primary_payment_type"]])
    assert plan(out).count("FileScan parquet") == plan(table).count("FileScan parquet")


def frame(spark, n=60_000, seed=1):
    rng = np.random.default_rng(seed)
    data = zip(rng.integers(0, 12, n).tolist(), rng.choice(["a", "b", None], n).tolist(), rng.integers(0, 20_000, n).tolist(),
               rng.lognormal(4, 1, n).tolist())
    df = spark.createDataFrame(list(data), "order_month int, customer_state string, customer_unique_id long, gross_revenue double")
    return {"fct_orders": df.withColumns({"is_revenue_order": F.col("customer_unique_id") % 10 > 0, "order_id": F.monotonically_increasing_id()})}


def test_states_by_month_merge_and_can_be_stored(spark, tmp_path):
    """States of each month, written apart, answer every slicer as the whole fact does."""
    tables, names = frame(spark), ["gross_revenue", "revenue_orders", "average_order_value", "buyers", "median_order_value"]
    states.measure_states(names, tables, ["order_month", "customer_state"]).write.partitionBy("order_month").parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    grains = [[], ["customer_state"], ["order_month"], ["order_month", "customer_state"]]
    pick = ["grain", "customer_state", "order_month", *names]
    a = rows(states.from_states(stored, names, grains).select([F.round(c, 6).alias(c) if c in names else c for c in pick]), *pick)
    b = rows(states.measures_by_grains(names, tables, grains).select([F.round(c, 6).alias(c) if c in names else c for c in pick]), *pick)
    assert a == b and len(a) == 1 + 3 + 12 + 36
    # A month replaced by its own state alone changes that month and what is above it.
    less = stored.filter("order_month <> 3")
    assert states.from_states(less, names, [["order_month"]]).count() == 11


def test_sketches_stay_within_their_errors(spark):
    tables, names = frame(spark, seed=5), ["buyers", "median_order_value", "gross_revenue"]
    grains = [[], ["customer_state"]]
    kept = states.measure_states(names, tables, ["order_month", "customer_state"], approximate=True)
    assert kept.count() == 36  # one row per group, whatever the number of persons and values
    rough = {(r.grain, r.customer_state): r for r in states.from_states(kept, names, grains, approximate=True).collect()}
    exact = {(r.grain, r.customer_state): r for r in states.measures_by_grains(names, tables, grains).collect()}
    assert rough.keys() == exact.keys()
    values = np.array([r.gross_revenue for r in tables["fct_orders"].filter("is_revenue_order").collect()])
    for key, r in exact.items():
        assert rough[key].buyers == pytest.approx(r.buyers, rel=5 * 1.04 / 2 ** (states.LG_K / 2))
        assert rough[key].gross_revenue == pytest.approx(r.gross_revenue)
    rank = (values <= rough["", None].median_order_value).mean()
    assert abs(rank - 0.5) < 0.03


def test_nulls_and_empty_tables(spark):
    tables = {"fct_orders": frame(spark, 50)["fct_orders"].withColumn("gross_revenue", F.lit(None).cast("double"))}
    for approximate in (False, True):
        r, = states.measures_by_grains(["median_order_value", "buyers"], tables, [[]], approximate).collect()
        assert r.median_order_value is None and r.buyers > 0
        empty = {"fct_orders": tables["fct_orders"].limit(0)}
        r, = states.measures_by_grains(["buyers", "gross_revenue"], empty, [[]], approximate).collect()
        assert (r.buyers, r.gross_revenue) == (0, None)
    with pytest.raises(ValueError, match="share a table"):
        states.measure_states(["mqls", "customers"], {}, [])
    with pytest.raises(ValueError, match="unknown"):
        states.measure_states(["profit"], {}, [])
