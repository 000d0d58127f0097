"""Compare a Spark result with a DuckDB result: schema, row count, values in any row order."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events".split()

KINDS = {
    "bigint": "int", "int": "int", "double": "float", "string": "text", "date": "date",
    "timestamp_ntz": "time", "boolean": "bool",
    "BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "text", "DATE": "date",
    "TIMESTAMP": "time", "BOOLEAN": "bool",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "item"):
        return _cell(value.item())
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, Decimal)):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ").removesuffix(" 00:00:00")
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def _rows(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    columns = [[_cell(v) for v in frame[n].tolist()] for n in names]
    return sorted(zip(*columns), key=repr)


def compare(schema, spark_frame: pd.DataFrame, described, oracle_frame: pd.DataFrame) -> str:
    """Empty string when equal, else the first difference."""
    ours = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in schema.fields}
    theirs = {row[0]: KINDS.get(row[1], row[1]) for row in described}
    if ours != theirs:
        diff = {k: (ours.get(k), theirs.get(k)) for k in ours.keys() | theirs.keys() if ours.get(k) != theirs.get(k)}
        return f"schema differs: {diff}"
    if len(spark_frame) != len(oracle_frame):
        return f"rows differ: {len(spark_frame)} vs {len(oracle_frame)}"
    for a, b in zip(_rows(spark_frame), _rows(oracle_frame)):
        if a != b:
            return f"values differ: {a} vs {b}"
    return ""
