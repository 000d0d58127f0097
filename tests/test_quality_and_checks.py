from dataclasses import replace
from decimal import Decimal

import pytest
from helpers import at, customers, d, deals, items, leads, orders, payments, rows, sellers, plan

from storepulse.operators import checks, marts, quality
from storepulse.rules import Rules

R = Rules()


def test_payment_reconciliation_branches(spark):
    ids = [f"p{i}" for i in range(1, 8)]
    fact = marts.fct_orders(
        orders(spark, [(i, "c1", "delivered", "2018-01-01") for i in ids]),
        items(spark, [(i, "s1", 90, 10) for i in ids[:5]]),
        payments(spark, [("p1", "card", 100), ("p2", "card", 101), ("p3", "card", "101.01"),
                         ("p4", "card", "98.99"), ("p6", "card", 50)]),
        customers(spark, [("c1", "u1", "SP")]), R)
    got = rows(quality.dq_payment_reconciliation(fact, R), "order_id", "issue_type", "difference")
    assert got == [
        ("p3", "overpaid_vs_items", Decimal("1.01")), ("p4", "underpaid_vs_items", Decimal("-1.01")),
        ("p5", "missing_payment_record", Decimal("-100.00")), ("p6", "payment_without_items", Decimal("50.00")),
        ("p7", "no_payment_and_no_items", Decimal("0.00"))]


def test_lifecycle_branches(spark):
    day = "2018-01-{:02d}".format
    o = orders(spark, [
        ("1", "c", "delivered", day(1), day(2), day(3), None),
        ("2", "c", "shipped", day(1), day(2), day(3), day(4)),
        ("3", "c", "canceled", day(1), day(2), day(3), day(4)),
        ("4", "c", "delivered", day(2), day(1), day(3), day(4)),
        ("5", "c", "delivered", day(1), day(2), day(4), day(3)),
        ("6", "c", "delivered", day(3), day(3), day(2), day(4)),
        ("7", "c", "delivered", day(5), day(5), day(4), day(3)),
        ("8", "c", "delivered", day(1), day(2), day(3), day(4)),
        ("9", "c", "created", day(1)),
        ("10", "c", None, day(1), None, None, day(4)),
    ])
    assert rows(quality.dq_order_lifecycle_anomalies(o), "order_id", "issue_type") == [
        ("1", "delivered_status_no_delivery_date"), ("2", "delivery_date_but_not_delivered"),
        ("3", "canceled_after_delivery"), ("4", "approved_before_purchase"), ("5", "delivered_before_shipped"),
        ("6", "shipped_before_purchase"), ("7", "delivered_before_shipped")]


def test_orphans(spark):
    it = items(spark, [("o1", "s1", 1, 0), ("o2", "nobody", 1, 0), ("o3", None, 1, 0)])
    products = spark.createDataFrame([("p1", None, "unknown")], "product_id string, category_pt string, category string")
    deal = deals(spark, [("m1", "s1", "2018-01-01"), ("m2", None, "2018-01-02"), ("m3", "ghost", "2018-01-01 23:00:00"),
                         ("m4", "s1", "2018-01-02")])
    lead = leads(spark, [("m1", "2018-01-02"), ("m2", "2018-01-02"), ("m3", "2018-01-01")])
    got = rows(quality.dq_orphan_keys(it, sellers(spark, ["s1"]), products, deal, lead), "issue_type", "record_id")
    assert got == [
        ("closed_deal_seller_never_in_seller_table", "m2"), ("closed_deal_seller_never_in_seller_table", "m3"),
        ("closed_deal_without_lead", "m4"), ("closed_deal_won_before_first_contact", "m1"),
        ("order_item_seller_not_in_sellers", "o2"), ("order_item_seller_not_in_sellers", "o3"),
        ("product_missing_category", "p1")]


FACT = "order_id string, customer_unique_id string, order_date date, gross_revenue decimal(18,2), is_revenue_order boolean"


@pytest.fixture(scope="module")
def checkouts(spark):
    day, money = d("2018-01-01"), Decimal
    return spark.createDataFrame([
        ("b", "u1", day, money("50.00"), True), ("a", "u1", day, money("50.00"), True),
        ("c", "u2", day, money("50.00"), True), ("e", "u2", day, money("50.00"), False),
        ("f", "u3", day, money("50.00"), True), ("g", "u3", day, money("50.01"), True),
        ("h", None, day, money("7.00"), True), ("i", None, day, money("7.00"), True), ("j", None, day, money("7.00"), True),
    ], FACT)


def test_duplicates(checkouts):
    got = rows(quality.dq_possible_duplicate_orders(checkouts), "customer_unique_id", "order_count", "order_id")
    assert got == [("u1", 2, "a"), ("u1", 2, "b"), (None, 3, "h"), (None, 3, "i"), (None, 3, "j")]
    assert rows(quality.duplicate_groups(checkouts), "customer_unique_id", "order_count") == [("u1", 2), (None, 3)]


def daily(spark, counts, key=None):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(counts)], "i int, n int")
    out = df.selectExpr("timestamp_ntz'2018-01-01 12:00:00' + make_dt_interval(i) as purchased_at", "n").filter("n > 0")
    out = out.selectExpr("purchased_at", "explode(sequence(1, n)) as k")
    return out.selectExpr("purchased_at", f"'{key}' as key") if key else out


def test_volume(spark):
    counts = [40] * 30 + [12, 11, 0, 40]
    got = rows(quality.dq_volume_anomalies(daily(spark, counts), R), "order_date", "orders", "issue_type",
               "ratio_to_trailing_median")
    assert got == [(d("2018-02-01"), 11, "volume_below_30pct_of_trailing_median", 0.275),
                   (d("2018-02-02"), 0, "zero_volume_day", 0.0)]
    assert quality.dq_volume_anomalies(daily(spark, [19] * 30 + [1]), R).count() == 0


def test_volume_per_key(spark):
    both = daily(spark, [40] * 30 + [0, 40], "a").unionByName(daily(spark, [19] * 30 + [0, 19], "b"))
    assert rows(quality.dq_volume_anomalies(both, R, keys=["key"]), "key", "orders") == [("a", 0)]


def test_summary_and_findings(spark, checkouts):
    one = spark.createDataFrame([("x", Decimal("-5.00")), ("x", Decimal("2.50"))], "issue_type string, difference decimal(10,2)")
    none = spark.createDataFrame([], "issue_type string")
    dup = quality.duplicate_groups(checkouts.filter("customer_unique_id = 'u2'"))
    summary = quality.dq_summary(one, none, none, dup, none)
    assert rows(summary, "check_group", "issue_type", "records") == [
        ("duplicates", "possible_duplicate_checkout", 0), ("payment_reconciliation", "x", 2)]
    got = rows(quality.dq_findings(summary, one, quality.explanations(spark, R)), "issue", "amount_affected", "handling")
    assert got == [("possible_duplicate_checkout", None, "check order_count"), ("x", 7.5, "")]


def test_explanations_follow_the_rules(spark):
    strict = replace(R, payment_tolerance=Decimal("2.50"), volume_lookback=7)
    text = dict(rows(quality.explanations(spark, strict), "issue", "what_it_means"))
    assert text["overpaid_vs_items"] == "raised where payment_total - gross_revenue > 2.50"
    assert "7 days" in text["volume_below_30pct_of_trailing_median"]


def test_daily_volume_and_base(spark):
    o = orders(spark, [("a", "c", "x", "2018-05-31 23:59:59"), ("b", "c", "x", "2018-06-01"), ("e", "c", "x", "2018-06-01")])
    assert rows(quality.dq_daily_volume(o, d("2018-06-01")), "order_date", "orders") == [(d("2018-06-01"), 2)]
    assert quality.dq_base_count(o).first().orders == 3


def test_basic_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, None), (None, None), (2, "a")], "k int, v string")
    assert rows(checks.check_unique(df, "k"), "k", "n") == [(1, 2)]
    assert checks.check_not_null(df, "k").count() == 2
    assert rows(checks.check_accepted_values(df, "v", ["b"]), "v", "n") == [("a", 2)]
    parent = spark.createDataFrame([(1,)], "id int")
    assert rows(checks.check_relationships(df, "k", parent, "id"), "k") == [(2,)]
    assert rows(checks.check_unique_combination(df, ["k", "v"]), "k", "v", "n") == [(None, None, 2)]


def test_funnel_monotonic(spark):
    df = spark.createDataFrame(
        [("ok", True, True, True), ("skip", False, True, False), ("jump", True, False, True)],
        "mql_id string, is_won boolean, is_activated boolean, is_retained boolean")
    assert rows(checks.check_funnel_monotonic(df), "mql_id") == [("jump",), ("skip",)]


def test_daily_total_and_rate(spark):
    fact = spark.createDataFrame(
        [(f"o{i}", Decimal("10.00"), True, True) for i in range(50)],
        "order_id string, gross_revenue decimal(18,2), is_revenue_order boolean, in_analysis_window boolean")
    good = spark.createDataFrame([(Decimal("500.00"),)], "gross_revenue decimal(18,2)")
    bad = spark.createDataFrame([(Decimal("499.98"),)], "gross_revenue decimal(18,2)")
    assert checks.check_daily_reconciles(good, fact, R).count() == 0
    assert rows(checks.check_daily_reconciles(bad, fact, R), "daily_total", "fact_total") == [(499.98, 500.0)]


def test_payment_rate_reads_the_fact_once(spark):
    def paid(wrong):
        return spark.createDataFrame(
            [(f"o{i}", Decimal("10.00"), Decimal("5.00" if i < wrong else "10.00"), 1, True) for i in range(50)],
            "order_id string, gross_revenue decimal(18,2), payment_total decimal(18,2), item_count int, is_revenue_order boolean")

    assert checks.check_payment_recon_rate(paid(1), R).count() == 0
    two = checks.check_payment_recon_rate(paid(2), R)
    assert rows(two, "pct_unreconciled") == [(4.0,)]
    assert "Join" not in plan(two)


def test_run_checks_status(spark):
    df = spark.createDataFrame([(1, None), (1, 2)], "k int, v int")
    specs = [checks.Key("t", "k"), checks.Required("t", ("k", "v")),
             checks.Check("never", lambda t: t["t"].filter("k = 5")),
             checks.Check("soft", lambda t: t["t"].filter("k = 1"), severity="warn")]
    assert rows(checks.run_checks({"t": df}, specs), "check", "severity", "failures", "status") == [
        ("never", "error", 0, "pass"), ("soft", "warn", 2, "warn"), ("t.k:not_null", "error", 0, "pass"),
        ("t.k:not_null", "error", 0, "pass"), ("t.k:unique", "error", 1, "fail"), ("t.v:not_null", "error", 1, "fail")]


def test_tests_are_planned_together(spark):
    """Every kind of test against its own function, over nulls, repeats and clashing texts."""
    child = spark.createDataFrame(
        [(1, "a", 5), (1, "a", None), (2, None, 6), (None, "b", 7), (None, "b", 7), (9, "-", 9), (9, None, 9)], "k int, v string, p long")
    parent = spark.createDataFrame([(5,), (6,), (6,), (None,)], "id long")
    tables = {"c": child, "p": parent, "empty": child.limit(0)}
    specs = [
        checks.Key("c", "k"), checks.Key("p", "id"), checks.Required("c", ("v", "p")), checks.Accepted("c", "v", ("a",)),
        checks.References("c", "p", "p", "id"), checks.References("c", "p", "p", "id", severity="warn"),
        checks.UniqueTogether("c", ("k", "v")), checks.UniqueTogether("c", ("v", "k")), checks.Key("empty", "k"),
    ]
    got = [(r.check, r.severity, r.failures, r.status) for r in checks.run_checks(tables, specs).collect()]
    orphans = checks.check_relationships(child, "p", parent, "id").count()
    assert orphans == 4
    want = [
        ("c.k:unique", "error", checks.check_unique(child, "k").count(), "fail"), ("c.k:not_null", "error", 2, "fail"),
        ("p.id:unique", "error", 1, "fail"), ("p.id:not_null", "error", 1, "fail"),
        ("c.v:not_null", "error", 2, "fail"), ("c.p:not_null", "error", 1, "fail"),
        ("c.v:accepted_values", "error", checks.check_accepted_values(child, "v", ["a"]).count(), "fail"),
        ("c.p:relationships", "error", orphans, "fail"), ("c.p:relationships", "warn", orphans, "warn"),
        ("c:unique_combination", "error", checks.check_unique_combination(child, ["k", "v"]).count(), "fail"),
        ("c:unique_combination", "error", checks.check_unique_combination(child, ["v", "k"]).count(), "fail"),
        ("empty.k:unique", "error", 0, "pass"), ("empty.k:not_null", "error", 0, "pass"),
    ]
    assert sorted(got) == sorted(want)


def test_planned_tests_scan_each_table_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, i % 7, "x") for i in range(50)], "k int, v int, w string").write.parquet(path)
    table = spark.read.parquet(path)
    specs = [checks.Key("t", "k"), checks.Required("t", ("v", "w")), checks.UniqueTogether("t", ("k", "v")),
             checks.Accepted("t", "w", ("x",)), checks.References("t", "v", "t", "k")]
    text = plan(checks.run_checks({"t": table}, specs))
    assert text.count("FileScan parquet") == 1 and text.count("Exchange hashpartitioning(test") == 2


def test_profiles_answer_for_the_table(spark):
    """Counts by key stand for the rows: the table itself is not read."""
    profile = spark.createDataFrame([(5, 3, 1), (8, 2, 0), (None, 4, 2)], "p long, n long, none long")
    parent = spark.createDataFrame([(5,)], "id long")
    specs = [checks.References("c", "p", "p", "id"), checks.Required("c", ("v",))]
    out = checks.run_checks({"p": parent}, specs, {"c": [checks.Profile(profile, "p", "n", {"v": "none"})]})
    assert rows(out, "check", "failures") == [("c.p:relationships", 2), ("c.v:not_null", 3)]


def test_standard_checks_are_thirty():
    n = 0
    for spec in checks.standard_checks(R):
        n += 2 if isinstance(spec, checks.Key) else len(spec.columns) if isinstance(spec, checks.Required) else 1
    assert n == 30


def test_helpers_time():
    assert at(None) is None
