import datetime as dt
from dataclasses import replace

import pytest
from helpers import at, customers, d, deals, items, leads, orders, payments, rows, sellers

from storepulse.functions.calendar import dim_date, holiday_flags
from storepulse.operators import marts
from storepulse.rules import Rules

R = Rules()  # window ends 2018-08-19


def fact(spark, order_rows, item_rows, payment_rows=(), people=(("c1", "u1", "SP"),), r=R):
    pay = payments(spark, payment_rows) if payment_rows else payments(spark, [("none", "x", 1)])
    return marts.fct_orders(orders(spark, order_rows), items(spark, item_rows), pay, customers(spark, people), r)


def test_order_flags(spark):
    f = fact(spark, [
        ("end", "c1", "delivered", "2018-08-19 23:59:00"),
        ("midnight", "c1", "delivered", "2018-08-20 00:00:00"),
        ("late", "c1", "delivered", "2018-08-20 00:01:00"),
        ("canceled", "c1", "canceled", "2018-01-01"),
        ("empty", "c1", "delivered", "2018-01-01"),
        ("nostatus", "c1", None, "2018-01-01"),
    ], [(o, "s1", 10, 1) for o in ("end", "midnight", "late", "canceled", "nostatus")])
    got = {k: (rev, win) for k, rev, win in rows(f, "order_id", "is_revenue_order", "in_analysis_window")}
    assert got == {
        "end": (True, True), "midnight": (True, True), "late": (True, False), "canceled": (False, True),
        "empty": (False, True), "nostatus": (None, True),
    }
    strict = replace(R, window_end_exclusive=True)
    f = fact(spark, [("midnight", "c1", "delivered", "2018-08-20 00:00:00")], [("midnight", "s1", 1, 1)], r=strict)
    assert f.first().in_analysis_window is False


def test_primary_payment_type(spark):
    f = fact(
        spark, [(o, "c1", "delivered", "2018-01-01") for o in ("largest", "nulltype", "tie", "unpaid")], [],
        [("largest", "voucher", 60), ("largest", "card", 50), ("largest", "card", 50, 4),
         ("nulltype", None, 90), ("nulltype", "card", 5), ("tie", "boleto", 50), ("tie", "card", 50)])
    got = rows(f, "order_id", "primary_payment_type", "payment_total", "max_installments", "gross_revenue")
    assert [(a, b, None if c is None else float(c), e, float(g)) for a, b, c, e, g in got] == [
        ("largest", "voucher", 160.0, 4, 0.0), ("nulltype", "card", 95.0, 1, 0.0), ("tie", "card", 100.0, 1, 0.0),
        ("unpaid", None, None, None, 0.0)]


def test_daily_revenue_fills_gaps(spark):
    r = replace(R, analysis_end=dt.date(2018, 1, 5))
    f = fact(spark, [("a", "c1", "delivered", "2018-01-01 08:00:00"), ("b", "c1", "delivered", "2018-01-04 09:00:00")],
             [("a", "s1", 10, 1), ("b", "s1", 20, 2)], r=r)
    got = rows(marts.fct_daily_revenue(f, r), "order_date", "orders", "customers", "gross_revenue")
    assert [(x[0].day, x[1], x[2], float(x[3])) for x in got] == [
        (1, 1, 1, 11.0), (2, 0, 0, 0.0), (3, 0, 0, 0.0), (4, 1, 1, 22.0), (5, 0, 0, 0.0)]


def test_daily_revenue_after_the_end_is_empty(spark):
    f = fact(spark, [("a", "c1", "delivered", "2018-09-01")], [("a", "s1", 10, 1)])
    assert marts.fct_daily_revenue(f, R).count() == 0


def test_customer_dimension(spark):
    people = [("c1", "u1", None), ("c2", "u1", "RJ"), ("c3", "u1", "SP"), ("c4", "u2", "MG")]
    f = fact(spark, [
        ("a", "c1", "delivered", "2018-01-01 10:00:00"), ("b", "c2", "delivered", "2018-01-02 10:00:00"),
        ("c", "c3", "delivered", "2018-03-01 10:00:00"), ("x", "c4", "delivered", "2018-08-19 12:00:00"),
    ], [(o, "s1", 10, 0) for o in "abcx"], people=people)
    got = rows(marts.dim_customers(f, R), "customer_unique_id", "order_count", "first_state", "recency_days",
               "is_repeat_customer", "cohort_month")
    assert got == [("u1", 3, "RJ", 171, True, d("2018-01-01")), ("u2", 1, "MG", 0, False, d("2018-08-01"))]


@pytest.fixture(scope="module")
def sale_months(spark):
    r = replace(R, analysis_end=dt.date(2018, 4, 30))
    o = orders(spark, [
        ("a", "c", "delivered", "2018-01-31 23:00:00"), ("b", "c", "delivered", "2018-03-01 00:00:00"),
        ("c", "c", "delivered", "2018-03-01 00:00:00"), ("e", "c", "delivered", "2018-02-28 00:00:00"),
        ("x", "c", "canceled", "2018-02-10"),
    ])
    i = items(spark, [("a", "s1", 10, 0), ("a", "s1", 5, 0), ("b", "s1", 7, 0), ("c", "s2", 1, 0), ("x", "s1", 99, 0),
                      ("e", "s3", 4, 0)])
    return marts.active_months(marts.seller_sales(i, o, r), "seller_id"), r


def test_seller_panel(sale_months):
    months, r = sale_months
    got = [x[1:] for x in rows(marts.fct_seller_monthly(months, r), "seller_id", "month", "months_since_first_sale",
                               "orders", "item_revenue", "is_active") if x[0] == "s1"]
    assert [(m.month, age, n, float(v), on) for m, age, n, v, on in got] == [
        (1, 0, 1, 15.0, True), (2, 1, 0, 0.0, False), (3, 2, 1, 7.0, True), (4, 3, 0, 0.0, False)]


def test_seller_status_at_sixty_days(spark, sale_months):
    months, r = sale_months
    dim = marts.dim_sellers(sellers(spark, ["s1", "s2", "s3", "s4"]), months, deals(spark, [("m", "s2", "2018-01-01")]), r)
    got = rows(dim, "seller_id", "lifecycle_status", "days_since_last_sale", "orders", "acquired_via_marketing_funnel")
    assert got == [("s1", "active", 60, 2, False), ("s2", "active", 60, 1, True), ("s3", "churned", 61, 1, False),
                   ("s4", "never_sold", None, 0, False)]


def test_lead_funnel_stages(spark):
    o = orders(spark, [(f"o{m}", "c", "delivered", f"2018-0{m}-10") for m in (1, 2, 3)])
    i = items(spark, [("o1", "two", 1, 0), ("o2", "two", 1, 0), ("o1", "three", 1, 0), ("o2", "three", 1, 0),
                      ("o3", "three", 1, 0), ("o3", "other", 1, 0)])
    months = marts.active_months(marts.seller_sales(i, o, R), "seller_id")
    f = marts.fct_lead_funnel(
        leads(spark, [(m, "2018-01-01") for m in ("lost", "nosale", "two", "three")]),
        deals(spark, [("nosale", "ghost", "2018-01-05 23:00:00"), ("two", "two", "2018-01-06"),
                      ("three", "three", "2018-01-01")]), months, R)
    got = rows(f, "mql_id", "is_won", "is_activated", "is_retained", "active_months", "days_to_close",
               "days_won_to_first_sale")
    assert got == [
        ("lost", False, False, False, 0, None, None), ("nosale", True, False, False, 0, 4, None),
        ("three", True, True, True, 3, 0, 9), ("two", True, True, False, 2, 5, 4)]


def test_dim_date(spark):
    got = rows(dim_date(spark, d("2018-12-30"), d("2019-01-01")), "date", "year_month", "day_of_week", "week_start")
    assert got == [
        (d("2018-12-30"), "2018-12", 0, d("2018-12-24")), (d("2018-12-31"), "2018-12", 1, d("2018-12-31")),
        (d("2019-01-01"), "2019-01", 2, d("2018-12-31"))]
    assert dim_date(spark, d("2019-01-01"), d("2018-01-01")).count() == 0


def test_holiday_flags(spark):
    weeks = ["2017-11-20", "2018-11-19", "2019-11-18", "2019-11-25", "2017-12-18", "2017-12-25", "2018-12-24", "2018-12-31"]
    df = spark.createDataFrame([(d(w),) for w in weeks], "week date")
    got = {str(w): (b, c) for w, b, c in rows(holiday_flags(df), "week", "black_friday_week", "christmas_week")}
    assert [w for w in weeks if got[w][0]] == ["2017-11-20", "2018-11-19", "2019-11-18"]
    assert [w for w in weeks if got[w][1]] == ["2017-12-25", "2018-12-24", "2018-12-31"]
    alt = {str(w): b for w, b in rows(holiday_flags(df, after_thanksgiving=True), "week", "black_friday_week")}
    assert [w for w in weeks if alt[w]] == ["2017-11-20", "2018-11-19", "2019-11-25"]


def test_rules():
    assert R.last_full_month == dt.date(2018, 7, 1)
    assert replace(R, analysis_end=dt.date(2018, 8, 31)).last_full_month == dt.date(2018, 8, 1)
    assert R.window_limit == at("2018-08-20")
