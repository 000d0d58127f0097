"""Adapter: order/line/event benchmark tables presented as the nine raw source tables.

Orders, lines, customers, suppliers and parts are used whole. Of the events, each user's
first signup is a lead, and a user's first purchase above 100 is the deal that follows: most
signups then end without a deal, as leads do; other events have no place in this data model.
Values that the benchmark tables lack (approval and delivery times) are derived from order
columns; narrow price bands stand for the faults that the quality checks look for.
"""

from __future__ import annotations

import datetime as dt
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.functions.lazy import LazyTables
from storepulse.rules import Rules

# Rules for the benchmark tables: dates of that data, thresholds for its volume.
RULES = Rules(
    first_month=dt.date(1995, 1, 1),
    analysis_end=dt.date(2001, 7, 29),
    volume_report_since=dt.date(2001, 1, 1),
    week_start_from=dt.date(1995, 1, 2),
    volume_min_median=5.0,
    customer_cohort_min=30,
    seller_cohort_min=5,
    churn_from=dt.date(1996, 1, 1),
    min_segment_won=5,
    min_origin_leads=10,
    forecast_weeks=18,
)

# Columns of the benchmark tables that the adapter reads.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

# Event clock: one event hour is one day of the lead calendar.
EVENT_START = "2024-01-01 00:00:00"
LEAD_START = dt.date(2000, 12, 1)

ORIGINS = (
    "Organic_Search", "Paid_Search", "Social", "", "Direct_Traffic",
    "Email", "Referral", "Other", "Display", "Other_Publicities",
)
SEGMENTS = ("pet", "toys", "", "watches", "books")
LEAD_TYPES = ("online_big", "online_small", "", "offline")
BUSINESS_TYPES = ("reseller", "manufacturer", "")

TRANSLATION = (
    ("ECONOMY", "economy"), ("LARGE", "large"), ("MEDIUM", "medium"), ("STANDARD", "standard"),
)


def _price_band(low: int, high: int) -> Column:
    price = F.col("o_totalprice")
    return (price >= low) & (price < high)


def _pick(names: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (number % len(names)).cast("int") + 1)


def _lead_day(ts: str) -> Column:
    hours = F.timestamp_diff("HOUR", F.lit(EVENT_START).cast("timestamp_ntz"), F.col(ts))
    return F.date_add(F.lit(LEAD_START), hours.cast("int"))


class Source:
    """Lazy raw tables over one folder of benchmark Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._read: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        # The given schema saves a footer-reading job per table.
        if name not in self._read:
            self._read[name] = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    def orders(self) -> DataFrame:
        bought = F.col("o_orderdate")
        hour, day = F.expr("interval 1 hour"), F.expr("interval 1 day")
        status = F.col("o_orderstatus")
        delivered = (
            F.when(status == "F", F.when(_price_band(10_000, 15_000), None)
                   .when(_price_band(15_000, 20_000), bought + day)
                   .otherwise(bought + F.expr("interval 7 days")))
            .when((status == "O") & _price_band(20_000, 25_000), bought + F.expr("interval 7 days"))
            .when((status == "P") & _price_band(25_000, 30_000), bought + F.expr("interval 7 days"))
        )
        return self.table("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.when(status == "F", "DELIVERED").when(status == "O", "Shipped")
            .otherwise("canceled").alias("order_status"),
            bought.alias("order_purchase_timestamp"),
            F.when(_price_band(0, 5_000), bought - hour).otherwise(bought + hour).alias("order_approved_at"),
            F.when(_price_band(5_000, 10_000), bought - day).otherwise(bought + F.expr("interval 2 days"))
            .alias("order_delivered_carrier_date"),
            delivered.alias("order_delivered_customer_date"),
            (bought + F.expr("interval 30 days")).alias("order_estimated_delivery_date"),
        )

    def order_items(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_quantity").alias("freight_value"),
        )

    def order_payments(self) -> DataFrame:
        """One payment per charged line (open returned lines are never charged, the top
        tax class pays a fee) and a small gift voucher on every urgent order."""
        flag = F.col("l_returnflag")
        money = "decimal(12,2)"
        lines = self.table("lineitem").filter(~((flag == "R") & (F.col("l_linestatus") == "O"))).select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("payment_sequential"),
            F.when(flag == "A", "Credit_Card").when(flag == "N", "Debit_Card").otherwise("Voucher")
            .alias("payment_type"),
            F.col("l_linenumber").alias("payment_installments"),
            (
                F.col("l_extendedprice").cast(money) + F.col("l_quantity").cast(money)
                + F.when(F.col("l_tax") == 0.08, F.lit("2").cast(money)).otherwise(F.lit("0").cast(money))
            ).cast(money).alias("payment_value"),
        )
        gifts = self.table("orders").filter(F.col("o_orderpriority") == "1-URGENT").select(
            F.col("o_orderkey").alias("order_id"),
            F.lit(0).alias("payment_sequential"),
            F.lit("Gift").alias("payment_type"),
            F.lit(1).alias("payment_installments"),
            F.lit("0.50").cast(money).alias("payment_value"),
        )
        return lines.unionByName(gifts)

    def customers(self) -> DataFrame:
        nation = self.table("nation").select("n_nationkey", "n_name")
        customer = self.table("customer")
        return customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_unique_id"),
            F.col("c_nationkey").cast("string").alias("customer_zip_code_prefix"),
            F.col("c_mktsegment").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )

    def sellers(self) -> DataFrame:
        nation = self.table("nation").select("n_nationkey", "n_name")
        supplier = self.table("supplier")
        return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "left").select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("s_nationkey").cast("string").alias("seller_zip_code_prefix"),
            F.col("s_name").alias("seller_city"),
            F.lower("n_name").alias("seller_state"),
        )

    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"),
            F.nullif(F.col("p_type"), F.lit("SMALL")).alias("product_category_name"),
        )

    def category_translation(self) -> DataFrame:
        return self.spark.createDataFrame(
            list(TRANSLATION), "product_category_name string, product_category_name_english string"
        )

    def _first_event(self, event_type: str, above: float | None = None) -> DataFrame:
        """First event of one type per user (earliest time, then lowest id)."""
        events = self.table("events").filter(F.col("event_type") == event_type)
        if above is not None:
            events = events.filter(F.col("value") > above)
        k = F.get_json_object("props", "$.k").cast("bigint")
        first = F.min(F.struct("ts", "event_id", k.alias("k"), "value"))
        return events.groupBy("user_id").agg(first.alias("e")).select("user_id", "e.*")

    def marketing_qualified_leads(self) -> DataFrame:
        return self._first_event("signup").select(
            F.col("user_id").alias("mql_id"),
            _lead_day("ts").alias("first_contact_date"),
            F.col("k").alias("landing_page_id"),
            _pick(ORIGINS, F.col("k")).alias("origin"),
        )

    def closed_deals(self) -> DataFrame:
        """A user's first purchase above 100 closes the deal; the user is the seller."""
        return self._first_event("purchase", above=100.0).select(
            F.col("user_id").alias("mql_id"),
            F.col("user_id").alias("seller_id"),
            (F.col("k") % 7).alias("sdr_id"),
            (F.col("k") % 11).alias("sr_id"),
            _lead_day("ts").cast("timestamp_ntz").alias("won_date"),
            _pick(SEGMENTS, F.col("k")).alias("business_segment"),
            _pick(LEAD_TYPES, F.col("k")).alias("lead_type"),
            _pick(BUSINESS_TYPES, F.col("k")).alias("business_type"),
            F.when(F.col("k") % 4 == 0, "n/a").otherwise((F.col("k") * 100).cast("string"))
            .alias("declared_monthly_revenue"),
        )

    def raw(self) -> LazyTables:
        return LazyTables({
            "orders": self.orders,
            "order_items": self.order_items,
            "order_payments": self.order_payments,
            "customers": self.customers,
            "sellers": self.sellers,
            "products": self.products,
            "category_translation": self.category_translation,
            "marketing_qualified_leads": self.marketing_qualified_leads,
            "closed_deals": self.closed_deals,
        })

    def raw_text(self) -> LazyTables:
        """The raw tables as a CSV reader gives them: every column is text."""
        raw = self.raw()

        def as_text(name: str) -> DataFrame:
            df = raw[name]
            return df.select([F.col(c).cast("string").alias(c) for c in df.columns])

        return LazyTables({name: partial(as_text, name) for name in raw})
