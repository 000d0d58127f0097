"""Session settings the jobs rely on.

Only SQL runtime settings are touched, so this works on a session that a
cluster already started. Partition counts and memory stay the cluster's choice.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession

# Adaptive execution splits a hot join key at run time; forcing it keeps that
# split even where the aggregation above then needs one more shuffle.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# What a task reads after a shuffle at most, compressed, where the cluster leaves more to it: its
# sorts and hash tables then take some hundred MB, however large the input. Adaptive execution
# merges small partitions up to this size only; it takes no partition apart for it.
TASK_INPUT = 16 << 20
_TASK_SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"

# Static settings for sessions started here: recording the call site of every column
# expression costs several JVM calls each.
START_CONF = {"spark.ui.enabled": "false", "spark.python.sql.dataFrameDebugging.enabled": "false"}


def _bytes(size: str) -> int:
    """A size as Spark writes it: `64MB`, `8m`, `20480`."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    chosen = spark.conf.get(_TASK_SIZE, None)
    if chosen is None or _bytes(chosen) > TASK_INPUT:
        spark.conf.set(_TASK_SIZE, f"{TASK_INPUT}b")
    return spark


def local_session(cpus: str | int | None = None, app: str = "storepulse") -> SparkSession:
    """Single-machine session for tests and the bench."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
    )
    for key, value in {**START_CONF, **RUNTIME_CONF}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
