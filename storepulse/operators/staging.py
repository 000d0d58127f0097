"""Staging: names and types. One raw row gives one typed row; NULLs and blanks are settled here."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storepulse.functions.lazy import LazyTables

MONEY = "decimal(12,2)"
TIME = "timestamp_ntz"


def _as(column: str, name: str, kind: str | None = None) -> Column:
    source = F.col(column)
    return (source.cast(kind) if kind else source).alias(name)


def _or_unknown(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("unknown"))


def stg_orders(raw: DataFrame) -> DataFrame:
    return raw.select(
        "order_id",
        "customer_id",
        F.lower("order_status").alias("order_status"),
        _as("order_purchase_timestamp", "purchased_at", TIME),
        _as("order_approved_at", "approved_at", TIME),
        _as("order_delivered_carrier_date", "shipped_at", TIME),
        _as("order_delivered_customer_date", "delivered_at", TIME),
        _as("order_estimated_delivery_date", "estimated_delivery_at", TIME),
    )


def stg_order_items(raw: DataFrame) -> DataFrame:
    return raw.select(
        "order_id",
        _as("order_item_id", "order_item_id", "int"),
        "product_id",
        "seller_id",
        _as("shipping_limit_date", "shipping_limit_at", TIME),
        _as("price", "item_price", MONEY),
        _as("freight_value", "freight_value", MONEY),
    )


def stg_order_payments(raw: DataFrame) -> DataFrame:
    return raw.select(
        "order_id",
        _as("payment_sequential", "payment_sequential", "int"),
        F.lower("payment_type").alias("payment_type"),
        _as("payment_installments", "payment_installments", "int"),
        _as("payment_value", "payment_value", MONEY),
    )


def _place(prefix: str) -> list[Column]:
    return [
        F.col(f"{prefix}_zip_code_prefix").alias("zip_prefix"),
        F.lower(f"{prefix}_city").alias("city"),
        F.upper(f"{prefix}_state").alias("state"),
    ]


def stg_customers(raw: DataFrame) -> DataFrame:
    """customer_id may be issued per order; customer_unique_id is the person."""
    return raw.select("customer_id", "customer_unique_id", *_place("customer"))


def stg_sellers(raw: DataFrame) -> DataFrame:
    return raw.select("seller_id", *_place("seller"))


def stg_products(raw_products: DataFrame, raw_translation: DataFrame) -> DataFrame:
    """Category in English where known, else as given, else 'unknown'."""
    names = raw_translation.select(
        F.col("product_category_name").alias("category_pt"), "product_category_name_english"
    )
    products = raw_products.select("product_id", F.col("product_category_name").alias("category_pt"))
    category = F.coalesce("product_category_name_english", "category_pt", F.lit("unknown"))
    return products.join(names, "category_pt", "left").select(
        "product_id", "category_pt", category.alias("category")
    )


def stg_leads(raw: DataFrame) -> DataFrame:
    return raw.select(
        "mql_id",
        _as("first_contact_date", "first_contact_date", "date"),
        "landing_page_id",
        _or_unknown(F.lower("origin")).alias("origin"),
    )


def stg_closed_deals(raw: DataFrame) -> DataFrame:
    groups = [_or_unknown(F.col(c)).alias(c) for c in ("business_segment", "lead_type", "business_type")]
    return raw.select(
        "mql_id",
        "seller_id",
        "sdr_id",
        "sr_id",
        _as("won_date", "won_at", TIME),
        *groups,
        F.col("declared_monthly_revenue").try_cast("double").alias("declared_monthly_revenue"),
    )


def stage_all(raw: Mapping[str, DataFrame]) -> LazyTables:
    """All staging tables, each built when first used."""
    return LazyTables({
        "stg_orders": lambda: stg_orders(raw["orders"]),
        "stg_order_items": lambda: stg_order_items(raw["order_items"]),
        "stg_order_payments": lambda: stg_order_payments(raw["order_payments"]),
        "stg_customers": lambda: stg_customers(raw["customers"]),
        "stg_sellers": lambda: stg_sellers(raw["sellers"]),
        "stg_products": lambda: stg_products(raw["products"], raw["category_translation"]),
        "stg_leads": lambda: stg_leads(raw["marketing_qualified_leads"]),
        "stg_closed_deals": lambda: stg_closed_deals(raw["closed_deals"]),
    })
