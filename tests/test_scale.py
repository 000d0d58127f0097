"""Plans and skew: what must hold before a job meets a hundred terabytes."""

import re
from contextlib import contextmanager

from pyspark.sql import functions as F
from helpers import customers, items, orders, payments, plan, rows

from storepulse import session
from storepulse.functions import shared
from storepulse.operators import marts, quality, retention
from storepulse.plans import registry
from storepulse.plans.registry import BenchmarkWorkspace
from storepulse.rules import Rules


FOLDER = "/root/testdata/sf0.001"
R = Rules()


@contextmanager
def conf(spark, **settings):
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_daily_revenue_reads_no_payments_and_few_columns(spark):
    text = re.sub(r"#\d+L?", "", plan(BenchmarkWorkspace(spark, FOLDER).fct_daily_revenue))
    columns = set(re.findall(r"\bl_\w+", text))
    assert columns == {"l_orderkey", "l_quantity", "l_extendedprice"}
    assert text.count("FileScan parquet") == 4  # orders, customer, nation, lineitem once each


def test_filters_reach_the_scan(spark):
    text = plan(BenchmarkWorkspace(spark, FOLDER).seller_sales)
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(o_orderdate", text)


def test_order_fact_has_one_shuffle_per_side_of_the_order_join(spark):
    with conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        text = re.sub(r"#\d+L?", "", plan(BenchmarkWorkspace(spark, FOLDER).fct_orders))
    assert len(re.findall(r"Exchange hashpartitioning\(order_id,", text)) == 3
    assert len(re.findall(r"Exchange hashpartitioning\(customer_id,", text)) == 2


SMALL_SKEW = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "20KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "20KB",
}


def hot_orders(spark, n=30_000):
    """A third of the orders belong to one customer, a third of the lines to one seller and order."""
    return spark.range(n).select(
        F.concat(F.lit("o"), "id").alias("order_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 997)).alias("customer_id"),
        F.lit("delivered").alias("order_status"),
        F.expr("timestamp_ntz'2017-01-01' + make_dt_interval(cast(id % 500 as int))").alias("purchased_at"),
        *[F.lit(None).cast("timestamp_ntz").alias(c) for c in
          ("approved_at", "shipped_at", "delivered_at", "estimated_delivery_at")],
    )


def hot_items(spark, n=30_000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "o0").otherwise(F.concat(F.lit("o"), "id")).alias("order_id"),
        F.col("id").cast("int").alias("order_item_id"), F.lit("p").alias("product_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 101)).alias("seller_id"),
        F.lit(None).cast("timestamp_ntz").alias("shipping_limit_at"),
        F.lit(2).cast("decimal(12,2)").alias("item_price"), F.lit(1).cast("decimal(12,2)").alias("freight_value"),
    )


def hot_people(spark):
    ids = spark.range(997).select(F.concat(F.lit("c"), "id").alias("customer_id"))
    ids = ids.unionByName(spark.createDataFrame([("hot",)], "customer_id string"))
    return ids.select("customer_id", F.concat(F.lit("u-"), "customer_id").alias("customer_unique_id"),
                      *[F.lit("x").alias(c) for c in ("zip_prefix", "city", "state")])


def test_hot_customer_is_split_and_results_stay_whole(spark):
    with conf(spark, **SMALL_SKEW):
        o, i, people = hot_orders(spark), hot_items(spark), hot_people(spark)
        fact = marts.fct_orders(o, i, payments(spark, [("o0", "card", 1)]), people, R)
        collected = fact.select("order_id", "customer_unique_id", "gross_revenue", "is_revenue_order")
        collected.collect()
        assert "skewed" in plan(collected)
        assert fact.count() == 30_000
        people_dim = {r.customer_unique_id: r for r in marts.dim_customers(fact, R).collect()}
        assert people_dim["u-hot"].order_count == 1  # o0 holds every third line, the other hot orders have none
        assert float(people_dim["u-hot"].lifetime_revenue) == 30_000.0
        months = marts.active_months(marts.seller_sales(i, o, R), "seller_id")
        sold = {r.seller_id: float(r.v) for r in months.groupBy("seller_id").agg(F.sum("item_revenue").alias("v")).collect()}
        assert sold["hot"] == 20_000.0 and sum(sold.values()) == 60_000.0


def test_hot_duplicate_group_keeps_all_members(spark):
    fact = spark.range(150_000).select(
        F.col("id").alias("order_id"), F.when(F.col("id") < 50_000, "hot").otherwise(F.col("id").cast("string"))
        .alias("customer_unique_id"), F.lit("2018-01-01").cast("date").alias("order_date"),
        F.lit(5).cast("decimal(18,2)").alias("gross_revenue"), F.lit(True).alias("is_revenue_order"))
    with conf(spark, **SMALL_SKEW):
        found = quality.dq_possible_duplicate_orders(fact)
        got = found.agg(F.count_distinct("order_id").alias("n"), F.min("order_count").alias("size")).first()
        assert (got.n, got["size"]) == (50_000, 50_000)


def test_hot_person_collapses_before_the_shuffle(spark):
    """Cohorts, gaps and churn group a person's orders by day or month first."""
    fact = BenchmarkWorkspace(spark, FOLDER).fct_orders
    text = re.sub(r"#\d+L?", "", plan(retention.customer_history(fact)))
    windows = text[: text.index("partial_count(1)")]
    assert "Window" in windows and "keys=[customer_unique_id, order_date]" in text


def test_null_customer_and_small_example(spark):
    f = marts.fct_orders(
        orders(spark, [("a", None, "delivered", "2018-01-01")]), items(spark, [("a", "s", 1, 0)]),
        payments(spark, [("a", "card", 1)]), customers(spark, [("c", "u", "SP")]), R)
    assert rows(f, "order_id", "customer_unique_id") == [("a", None)]


def scans(df, table):
    df.collect()
    text = plan(df).split("== Initial Plan ==")[0]
    return len(re.findall(rf"FileScan parquet[^\n]*/{table}\.parquet", text))


def test_checks_and_summaries_read_each_table_few_times(spark):
    """Items and payments come from the same lines here: one scan each, and one for sales per seller."""
    queries = registry.queries()
    assert scans(queries["run_checks"](spark, FOLDER), "lineitem") == 3
    assert scans(queries["dq_summary"](spark, FOLDER), "lineitem") == 2
    assert scans(queries["dq_findings"](spark, FOLDER), "lineitem") == 2


def test_a_shared_frame_is_computed_once(spark):
    source = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    per_order = shared.once(source.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.max("l_tax").alias("t")))
    readers = [per_order.filter("t > 0.05").agg(F.sum("q").alias("x")), per_order.groupBy("t").count().agg(F.max("t").alias("x")),
               per_order.filter("l_orderkey < 10").select(F.col("q").alias("x"))]
    both = readers[0].union(readers[1]).union(readers[2])
    assert scans(both, "lineitem") == 1
    plain = source.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.max("l_tax").alias("t"))
    assert sorted(r.x for r in both.collect())[-1] == plain.filter("t > 0.05").agg(F.sum("q")).first()[0]


def test_a_task_reads_little_after_a_shuffle_unless_the_cluster_wants_less(spark):
    """Else sorts and hash tables of sales per seller and month grow with what adaptive execution merges."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    with conf(spark, spark__sql__adaptive__advisoryPartitionSizeInBytes="64MB"):
        session.configure(spark)
        assert spark.conf.get(key) == "16777216b"
        for small in ("8m", "20KB", "4096", "16777216b"):
            spark.conf.set(key, small)
            session.configure(spark)
            assert spark.conf.get(key) == small
        spark.conf.unset(key)
        registry.queries()["dim_sellers"](spark, FOLDER)
        assert spark.conf.get(key) == "16777216b"
