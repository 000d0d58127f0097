import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from helpers import at, d, rows

from storepulse.functions.stats import exact_quantiles, fixed_histogram, quartile_score, wilson_interval
from storepulse.operators import funnel, measures, retention
from storepulse.rules import Rules
from pyspark.sql import functions as F

R = Rules()
FUNNEL = (
    "mql_id string, origin string, first_contact_date date, won_at timestamp_ntz, business_segment string, "
    "is_won boolean, is_activated boolean, is_retained boolean, days_to_close bigint, days_won_to_first_sale bigint, "
    "seller_item_revenue double"
)


def lead(i, contact="2018-01-01", won=None, flags=(False, False, False), origin="email", seg=None, close=None, sale=None):
    return (str(i), origin, d(contact), at(won), seg, *flags, close, sale, 10.0)


def test_maturity_and_late_deals(spark):
    df = spark.createDataFrame([
        lead(1, "2018-04-21"), lead(2, "2018-04-22"),
        lead(3, won="2018-08-19 00:00:01", flags=(True, True, True)),
        lead(4, won="2018-08-19", flags=(True, True, True)),
    ], FUNNEL)
    got = rows(funnel.mature_leads(df, R), "mql_id", "is_won", "is_activated", "is_retained")
    assert got == [("1", False, False, False), ("3", False, False, False), ("4", True, True, True)]


# Published counts with their published rates.
ORIGINS = [
    ("organic_search", 1853, 202, 90, 10.9, 9.6, 12.4, 44.6), ("paid_search", 1239, 142, 84, 11.5, 9.8, 13.4, 59.2),
    ("social", 988, 57, 27, 5.8, 4.5, 7.4, 47.4), ("email", 380, 11, 5, 2.9, 1.6, 5.1, 45.5),
    ("other", 135, 3, 2, 2.2, 0.8, 6.3, 66.7), ("other_publicities", 55, 3, 0, 5.5, 1.9, 14.9, 0.0),
]


def test_published_conversion(spark):
    n, won, act, kept = 6311, 630, 310, 157
    df = spark.range(n).selectExpr(f"id < {won} as is_won", f"id < {act} as is_activated", f"id < {kept} as is_retained")
    got = rows(funnel.funnel_overall(df), "position", "count", "pct_of_mql", "step_conversion_pct")
    assert got == [(1, 6311, 100.0, None), (2, 630, 9.98, 10.0), (3, 310, 4.91, 49.2), (4, 157, 2.49, 50.6)]


def test_published_origin_rates(spark):
    parts = [
        spark.range(n).selectExpr(f"'{o}' as origin", f"id < {w} as is_won", f"id < {a} as is_activated")
        for o, n, w, a, *_ in ORIGINS
    ]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    by = funnel.rounded_rates(funnel.funnel_by(df, R))
    got = {r.origin: (r.mqls, r.won, r.activated, r.win_rate_pct, r.win_ci_low, r.win_ci_high, r.activation_of_won_pct)
           for r in by.collect()}
    assert got == {o[0]: o[1:] for o in ORIGINS}
    ranked = funnel.win_rate_ranked(by, replace(R, min_origin_leads=100)).collect()
    assert [r.origin for r in ranked] == ["other", "email", "social", "organic_search", "paid_search"]


def test_zero_wins_and_zero_trials(spark):
    df = spark.createDataFrame([(0, 0), (0, 10)], "k int, n int")
    low, high = wilson_interval(F.col("k"), F.col("n"), 1.96)
    got = df.select(low.alias("lo"), high.alias("hi")).collect()
    assert got[0].lo is None and got[1].lo == pytest.approx(0.0, abs=1e-12) and got[1].hi == pytest.approx(0.2775, abs=1e-3)
    one = spark.createDataFrame([lead(1)], FUNNEL)
    assert funnel.funnel_by(one, R).first().activation_of_won_pct is None


def test_segments_and_timing(spark):
    won = [lead(i, flags=(True, i % 3 == 0, False), seg="a", close=i) for i in range(15)]
    df = spark.createDataFrame(won + [lead(99, flags=(True, True, False), seg="small", close=-3, sale=8)], FUNNEL)
    got = rows(funnel.funnel_by_segment(df, R), "business_segment", "won", "activated", "median_days_to_close", "activation_pct")
    assert got == [("a", 15, 5, 7.0, 33.3)]
    days = [*range(15), -3]
    got = rows(funnel.funnel_timing(df), "metric", "median", "p75", "p90")
    assert got[0] == ("days_to_close", *(pytest.approx(np.quantile(days, p)) for p in (0.5, 0.75, 0.9)))
    assert got[1] == ("days_won_to_first_sale", 8.0, 8.0, 8.0)
    assert rows(funnel.funnel_timing(df, exclude_negative=True), "metric", "median")[0] == ("days_to_close", 7.0)


def test_histogram_against_numpy(spark):
    rng = np.random.default_rng(2)
    values = [int(v) for v in rng.integers(-20, 400, 500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x int")
    counts, edges = np.histogram(np.minimum(values, 200), bins=40)
    got = rows(fixed_histogram(df, "x", 40, 200.0), "bin", "bin_from", "count")
    got.sort()
    assert [c for _, _, c in got] == counts.tolist()
    assert [e for _, e, _ in got] == pytest.approx(edges[:-1].tolist())
    flat = fixed_histogram(spark.createDataFrame([(3,), (3,)], "x int"), "x", 4)
    assert [r["count"] for r in sorted(flat.collect())] == np.histogram([3, 3], bins=4)[0].tolist()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 3001, 40_000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.lognormal(3, 1, n), 2)
    values[: n // 3] = values[0]  # one value holds a third of the rows
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, "v", probs, also=[F.count(F.lit(1)).alias("rows")]).first()
    assert got.q == pytest.approx(np.quantile(values, probs), rel=1e-12)
    assert got.rows == n + 1


def test_exact_quantiles_of_spread_values(spark):
    """All values differ and lie unevenly, so the slices of a bracket matter."""
    df = spark.range(60_000).select((F.exp(F.col("id") / 3000) + F.col("id")).alias("v"))
    probs = [0.013, 0.25, 0.5, 0.9871]
    values = np.exp(np.arange(60_000) / 3000) + np.arange(60_000)
    assert exact_quantiles(df, "v", probs).first().q == pytest.approx(np.quantile(values, probs), rel=1e-12)


def test_rfm_bounds_the_passes_over_the_persons(spark):
    people = spark.range(100).selectExpr(
        "cast(id as string) as customer_unique_id", "id as recency_days", "1L as order_count", "id * 1.5D as lifetime_revenue")
    text = retention.rfm_scores(people)._jdf.queryExecution().optimizedPlan().toString()
    # Two passes for the edges and one for the scores; the counting pass is planned for both its uses.
    assert text.count("Range (") <= 5


def test_quartile_scores(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 5, 6, 7, 8)], "v int")
    edges = exact_quantiles(df, "v", [0.25, 0.5, 0.75]).scalar()
    assert [s for _, s in rows(df.select("v", quartile_score(F.col("v"), edges).alias("s")), "v", "s")] == [1, 1, 2, 2, 3, 3, 4, 4]
    tied = spark.createDataFrame([(v,) for v in (1, 1, 1, 2)], "v int")
    edges = exact_quantiles(tied, "v", [0.25, 0.5, 0.75]).scalar()
    assert [s for _, s in rows(tied.select("v", quartile_score(F.col("v"), edges).alias("s")), "v", "s")] == [1, 1, 1, 4]


def test_rfm_segments(spark):
    people = [("loyal", 1, 2, 10.0), ("new_high", 2, 1, 90.0), ("new_low", 3, 1, 5.0), ("x1", 4, 1, 50.0),
              ("lapsed", 50, 3, 60.0), ("risk", 60, 1, 95.0), ("dormant", 70, 1, 1.0), ("x2", 80, 1, 2.0)]
    df = spark.createDataFrame(people, "customer_unique_id string, recency_days bigint, order_count bigint, lifetime_revenue double")
    scores = retention.rfm_scores(df)
    got = dict(rows(scores, "customer_unique_id", "segment"))
    for who, key in (("loyal", "loyal"), ("new_high", "new_high"), ("new_low", "new_low"), ("lapsed", "lapsed"),
                     ("risk", "risk_high"), ("dormant", "dormant")):
        assert got[who] == retention.SEGMENTS[key]
    assert dict(rows(scores, "customer_unique_id", "R"))["loyal"] == 4
    seg = retention.rfm_segments(scores)
    assert sum(r.customers for r in seg.collect()) == 8
    assert seg.filter("segment = 'Dormant low-value one-timers'").first().customer_pct == 25.0


FACT = ("order_id string, customer_unique_id string, purchased_at timestamp_ntz, order_date date, order_month date, "
        "gross_revenue decimal(18,2), is_revenue_order boolean, in_analysis_window boolean")


def fact(spark, data):
    full = [(o, p, at(t), at(t).date(), at(t).date().replace(day=1), v, True, True) for o, p, t, v in data]
    raw = spark.createDataFrame(full, FACT.replace("decimal(18,2)", "double"))
    return raw.withColumn("gross_revenue", F.col("gross_revenue").cast("decimal(18,2)"))


def test_gaps_and_summary(spark):
    f = fact(spark, [
        ("1", "same", "2018-01-01 08:00:00", 10.0), ("2", "same", "2018-01-01 09:00:00", 10.0), ("3", "same", "2018-02-01", 10.0),
        ("4", "in", "2018-01-01 23:00:00", 10.0), ("5", "in", "2018-06-30 01:00:00", 10.0),
        ("6", "out", "2018-01-01", 10.0), ("7", "out", "2018-07-01", 10.0),
        ("8", "once", "2018-01-01", 30.0), ("9", "young", "2018-08-01", 10.0), ("10", "young", "2018-08-02", 10.0),
    ])
    gaps = rows(retention.second_order_gap(f), "customer_unique_id", "days_to_second")
    assert gaps == [("in", 180), ("out", 181), ("same", 0), ("young", 1)]
    got = dict(rows(retention.customer_retention_summary(f, R), "metric", "value"))
    assert got == {"customers": 5.0, "repeat_customer_pct": 80.0, "repurchase_within_180d_pct": 50.0,
                   "median_days_to_second_order": 90.5, "same_day_second_orders_pct": 25.0,
                   "revenue_share_from_repeat_customers_pct": 75.0}


def months(spark, data, entity="e"):
    return spark.createDataFrame([(e, d(f"{m}-01")) for e, m in data], f"{entity} string, month date")


def test_cohorts(spark):
    m = months(spark, [("a", "2018-01"), ("a", "2018-03"), ("b", "2018-01"), ("c", "2018-02"), ("c", "2018-03")])
    got = rows(retention.cohort_retention(m, "e", 2), "cohort_month", "age", "active", "size", "pct")
    assert got == [(d("2018-01-01"), 0, 2, 2, 100.0), (d("2018-01-01"), 2, 1, 2, 50.0)]
    wide = retention.cohort_matrix(retention.cohort_retention(m, "e", 1), range(3), 1)
    assert wide.columns == ["cohort_month", "0", "1", "2"]
    assert rows(wide, "cohort_month", "0", "1", "2") == [
        (d("2018-01-01"), 100.0, None, 50.0), (d("2018-02-01"), 100.0, 100.0, None)]


def test_churn_and_setwise_agree(spark):
    rng = np.random.default_rng(5)
    data = [(f"e{i}", f"{2017 + k // 12}-{k % 12 + 1:02d}") for i in range(40) for k in range(20) if rng.random() < 0.6]
    m = months(spark, data)
    r = replace(R, churn_from=dt.date(2017, 1, 1), analysis_end=dt.date(2018, 8, 31))
    churn = {x[0]: x[1:] for x in rows(retention.monthly_churn(m, "e", r), "month", "active_prev", "churned")}
    active = {}
    for e, month in data:
        active.setdefault(d(f"{month}-01"), set()).add(e)
    for month, (prev, lost) in churn.items():
        before = (month - dt.timedelta(days=1)).replace(day=1)
        assert (prev, lost) == (len(active[before]), len(active[before] - active.get(month, set())))
    sets = {x[0]: x[1:] for x in rows(measures.churn_setwise(m, "e", r), "month", "prev_active", "lost")}
    assert {k: sets[k] for k in churn} == churn and len(churn) == 19


def test_published_churn_rates(spark):
    """Active months with the published counts give the published rates."""
    # Published month, active before, churned, rate.
    published = [("2018-01-01", 859, 203, 23.6), ("2018-02-01", 968, 258, 26.7), ("2018-03-01", 933, 212, 22.7),
                 ("2018-04-01", 993, 224, 22.6), ("2018-05-01", 1116, 302, 27.1), ("2018-06-01", 1107, 307, 27.7),
                 ("2018-07-01", 1168, 314, 26.9)]
    active, data, born = [], [], 0
    for month, before, lost, _ in published:
        # Whoever is missing from the month before joins in it, then the churned leave.
        previous = (d(month) - dt.timedelta(days=1)).replace(day=1)
        joining = [f"s{born + i}" for i in range(before - len(active))]
        born += len(joining)
        active += joining
        data += [(s, previous) for s in active[-len(joining):] if joining] if data else [(s, previous) for s in active]
        active = active[lost:]
        data += [(s, d(month)) for s in active]
    m = spark.createDataFrame(data, "seller_id string, month date").distinct()
    churn = retention.monthly_churn(m, "seller_id", replace(R, churn_from=dt.date(2018, 1, 1)))
    assert rows(churn, "month", "active_prev", "churned", "monthly_churn_pct") == [(d(p[0]), *p[1:]) for p in published]
    assert round(retention.avg_churn(churn, 2018).first().avg_churn_pct, 1) == 25.3


def test_orders_without_a_customer_are_no_person(spark):
    data = [("1", "a", "2018-01-01", 10.0), ("2", "a", "2018-02-05", 10.0)]
    known = fact(spark, data)
    f = fact(spark, data + [("3", None, "2018-01-01", 10.0), ("4", None, "2018-02-01", 10.0)])
    assert rows(retention.second_order_gap(f), "customer_unique_id", "days_to_second") == [("a", 35)]
    got, base = (rows(retention.cohort_retention(retention.customer_months(x), "customer_unique_id", 1),
                      "cohort_month", "age", "active", "size") for x in (f, known))
    assert got == base
    assert dict(rows(retention.customer_retention_summary(f, R), "metric", "value"))["customers"] == 2.0
    m = months(spark, [("a", "2018-01"), (None, "2018-01"), (None, "2018-02")])
    assert rows(retention.cohort_retention(m, "e", 1), "age", "size") == [(0, 1)]


def test_size_bands(spark):
    df = spark.createDataFrame(
        [(str(n), n, "churned" if n < 10 else "active") for n in (1, 2, 3, 10, 11, 50, 51)] + [("never", 0, "never_sold")],
        "seller_id string, orders bigint, lifecycle_status string")
    got = rows(retention.churn_by_size(df, R), "size_band", "sellers", "churned_pct")
    assert got == [("1-2 orders", 2, 100.0), ("11-50", 2, 0.0), ("3-10", 2, 50.0), ("50+", 1, 0.0)]


def test_revenue_change_over_missing_months(spark):
    f = fact(spark, [("1", "u", "2017-01-05", 100.0), ("2", "u", "2017-02-05", 150.0), ("3", "u", "2017-04-05", 80.0),
                     ("4", "u", "2018-01-05", 50.0)])
    got = rows(measures.revenue_change(f, 1), "month", "change")
    assert got == [(d("2017-01-01"), None), (d("2017-02-01"), 0.5), (d("2017-04-01"), None), (d("2018-01-01"), None)]
    assert dict(rows(measures.revenue_change(f, 12), "month", "change"))[d("2018-01-01")] == -0.5


def test_measures_need_one_table(spark):
    with pytest.raises(ValueError):
        measures.measures(["mqls", "customers"], {})
