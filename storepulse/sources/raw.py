"""Raw CSV catalogue and readers. Everything stays text until staging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


@dataclass(frozen=True)
class RawTable:
    """File name under the raw folder and the columns staging reads from it."""

    file: str
    columns: tuple[str, ...]


# The source tables and the columns that staging reads.
CATALOG: dict[str, RawTable] = {
    "orders": RawTable("orders.csv", (
        "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
        "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date",
    )),
    "order_items": RawTable("order_items.csv", (
        "order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price", "freight_value",
    )),
    "order_payments": RawTable("order_payments.csv", (
        "order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value",
    )),
    "customers": RawTable("customers.csv", (
        "customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state",
    )),
    "sellers": RawTable("sellers.csv", (
        "seller_id", "seller_zip_code_prefix", "seller_city", "seller_state",
    )),
    "products": RawTable("products.csv", ("product_id", "product_category_name")),
    "category_translation": RawTable("category_translation.csv", (
        "product_category_name", "product_category_name_english",
    )),
    "marketing_qualified_leads": RawTable("marketing_qualified_leads.csv", (
        "mql_id", "first_contact_date", "landing_page_id", "origin",
    )),
    "closed_deals": RawTable("closed_deals.csv", (
        "mql_id", "seller_id", "sdr_id", "sr_id", "won_date", "business_segment", "lead_type",
        "business_type", "declared_monthly_revenue",
    )),
}


def catalog_with_files(files: Mapping[str, str]) -> dict[str, RawTable]:
    """The catalogue with other file names for some tables."""
    return {
        name: replace(table, file=files.get(name, table.file)) for name, table in CATALOG.items()
    }


class MissingInput(FileNotFoundError):
    """One or more raw inputs do not exist; the message names all of them."""


def _path(folder: str, table: RawTable) -> str:
    return f"{folder.rstrip('/')}/{table.file}"


MALFORMED = "_malformed"
# How fields are read, by the file reader and line by line alike.
_CSV = {"escape": '"', "nullValue": "", "emptyValue": "", "columnNameOfCorruptRecord": MALFORMED, "mode": "PERMISSIVE"}


def _names(spark: SparkSession, path: str) -> list[str]:
    """Column names, from the header row: extra or reordered columns are fine."""
    return spark.read.options(**_CSV).option("header", True).csv(path).columns


def _schema(names: Sequence[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in (*names, MALFORMED)])


def _scan(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """All rows as text; rows with too few or too many fields carry their text in the last column.

    Whole rows are parsed whatever columns are used, since a row's faults may lie in others;
    the files of a table must agree in their headers.
    """
    return (
        spark.read.schema(_schema(_names(spark, path))).options(**_CSV).option("header", True).option("enforceSchema", False)
        .option("columnPruning", False).option("multiLine", multi_line).csv(path)
    )


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of every line. Lines of a file are numbered by the blocks that tasks
    read: the number inside the block, plus the lines of all blocks before it."""
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"),
    )
    blocks = text.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    known = blocks.select("file", "block", "first", before.alias("before"))
    return text.join(known, ["file", "block"]).select(
        "file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "text")


def check_inputs(
    spark: SparkSession, folder: str, catalog: Mapping[str, RawTable] = CATALOG
) -> None:
    """Raise one error that names every missing file."""
    missing = []
    for table in catalog.values():
        try:
            spark.read.text(_path(folder, table))
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in (err.getCondition() or ""):
                raise
            missing.append(table.file)
    if missing:
        raise MissingInput(f"missing in {folder}: {', '.join(missing)}")


def read_raw(
    spark: SparkSession,
    folder: str,
    catalog: Mapping[str, RawTable] = CATALOG,
    multi_line: bool = False,
) -> dict[str, DataFrame]:
    """All catalogue tables as text columns. A table may be one file or a folder of parts.

    `multi_line` accepts line breaks inside quotes at the price of unsplittable files.
    Empty cells, quoted or not, are NULL. Rows with too few or too many fields are left out;
    `malformed` lists them.
    """
    check_inputs(spark, folder, catalog)
    tables = {}
    for name, table in catalog.items():
        df = _scan(spark, _path(folder, table), multi_line)
        absent = [c for c in table.columns if c not in df.columns]
        if absent:
            raise ValueError(f"{table.file} lacks columns: {', '.join(absent)}")
        # Spark refuses to read the last column alone, so a count needs another one in the condition.
        parsed = F.length(F.coalesce(F.col(f"`{df.columns[0]}`"), F.lit(""))) >= 0
        tables[name] = df.filter(F.col(MALFORMED).isNull() & parsed).drop(MALFORMED)
    return tables


def malformed(spark: SparkSession, folder: str, catalog: Mapping[str, RawTable] = CATALOG) -> DataFrame:
    """(table, file, line, text) of the rows that `read_raw` leaves out of one-line-a-row files.

    Lines are judged by the same parser and settings. Headers and blank lines are no rows.
    """
    check_inputs(spark, folder, catalog)
    parts = []
    for name, table in catalog.items():
        path = _path(folder, table)
        names = _names(spark, path)
        fields = F.from_csv("text", _schema(names).toDDL(), _CSV)
        faulty = _lines(spark, path).filter((F.col("line") > 1) & (F.trim("text") != "")).withColumn("fields", fields)
        parts.append(faulty.filter(F.col(f"fields.{MALFORMED}").isNotNull()).select(F.lit(name).alias("table"), "file", "line", "text"))
    return reduce(DataFrame.unionByName, parts)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: (table, rows)."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out
