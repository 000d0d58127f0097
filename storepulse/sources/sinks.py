"""Layered tables, views and report files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from storepulse.sources.versions import Version, VersionedTable

LAYERS = ("raw", "staging", "marts", "data_quality", "reports")


class Tables:
    """Named tables in layers, kept as versioned Parquet tables below one folder.

    A saved table is replaced as a whole or not at all: a write that fails, or a job that is
    killed, leaves the version before it in place. Saved tables are read back from their
    files, so no lineage grows across layers and any later job can open them by folder, layer
    and name. Views live in the session only.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.keep = keep
        self.views: dict[tuple[str, str], DataFrame] = {}

    def path(self, layer: str, name: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"unknown layer {layer!r}; use one of {LAYERS}")
        return f"{self.folder}/{layer}/{name}"

    def table(self, layer: str, name: str) -> VersionedTable:
        return VersionedTable(self.spark, self.path(layer, name))

    def view(self, layer: str, name: str, df: DataFrame) -> DataFrame:
        self.path(layer, name)
        self.views[layer, name] = df
        register_view(df, f"{layer}_{name}")
        return df

    def save(
        self, layer: str, name: str, df: DataFrame, partition_by: Sequence[str] = ()
    ) -> DataFrame:
        """Create or replace a table and return it as read back. Versions before the last
        `keep` are removed, so a job that opened the table before can still finish."""
        table = self.table(layer, name)
        version = save_table(df, table.path, partition_by)
        table.remove_old(self.keep)
        return self.view(layer, name, table.read(version))

    def replace_partitions(self, layer: str, name: str, df: DataFrame, values: Sequence[Mapping[str, object]]) -> DataFrame:
        """Replace some partitions of a table and return it as read back; the others are shared."""
        table = self.table(layer, name)
        version = table.replace_partitions(df, values)
        table.remove_old(self.keep)
        return self.view(layer, name, table.read(version))

    def get(self, layer: str, name: str, version: int | None = None) -> DataFrame:
        """A table of this folder: the view made here, or else the files of an earlier job. With
        `version`, that version from the files."""
        if version is not None:
            return self.table(layer, name).read(version)
        if (layer, name) not in self.views:
            self.view(layer, name, self.table(layer, name).read())
        return self.views[layer, name]

    def sql(self, text: str) -> DataFrame:
        """SQL over <layer>_<name>. The names are registered anew, so that two folders open in
        one session never answer for each other; tables that are only files need a `get` first."""
        for (layer, name), df in self.views.items():
            register_view(df, f"{layer}_{name}")
        return self.spark.sql(text)


def register_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> Version:
    """Write a new version of the table at `path`; the old one stays until the new one is complete."""
    return VersionedTable(df.sparkSession, path).write(df, partition_by)


def write_report(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header. Only summary-sized reports should use one file."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)


# The tables of the star schema that a BI tool imports.
STAR_TABLES = (
    "fct_orders", "fct_daily_revenue", "fct_lead_funnel", "fct_seller_monthly",
    "dim_customers", "dim_sellers", "dim_date", "dq_findings",
)

# Relations that may have rows without a parent: a lead's seller need never be listed.
LOOSE_RELATIONS = (("fct_lead_funnel", "seller_id"),)

# Many-to-one relations between the star tables.
STAR_RELATIONS = (
    ("fct_orders", "customer_unique_id", "dim_customers", "customer_unique_id"),
    ("fct_orders", "order_date", "dim_date", "date"),
    ("fct_lead_funnel", "seller_id", "dim_sellers", "seller_id"),
    ("fct_seller_monthly", "seller_id", "dim_sellers", "seller_id"),
)


def star_schema(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The exported star: order facts are limited to the analysis window, and the findings are
    the summary (check_group, issue_type, records)."""
    star = {name: tables["dq_summary" if name == "dq_findings" else name] for name in STAR_TABLES}
    star["fct_orders"] = star["fct_orders"].filter("in_analysis_window")
    return star


def export_star(tables: Mapping[str, DataFrame], folder: str) -> list[str]:
    """Write the star schema as CSV folders; returns their paths."""
    paths = []
    for name, df in star_schema(tables).items():
        path = f"{folder.rstrip('/')}/{name}"
        write_report(df, path, single_file=False)
        paths.append(path)
    return paths
