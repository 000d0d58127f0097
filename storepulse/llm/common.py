"""What the operators share: reading tables, written intermediate tables, column picking."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from storepulse import session

# Words as in the contracts: runs of anything but space, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rows of one Arrow batch that Python sees at once; texts of 100 KB then stay below 50 MB.
BATCH_ROWS = 500


# A worker's memory of words or fragments: bytes (about) before it starts afresh, the longest
# text that is remembered, and the bytes of an entry besides. Bounds memory, never results.
REMEMBERED, WORTH, ENTRY = 64 << 20, 64, 190

_shipped: set[str] = set()


class Remembered(dict):
    """Text -> value computed from it, kept for short texts up to a number of bytes."""

    def __init__(self, compute):
        self.compute, self.held = compute, 0

    def __missing__(self, text):
        found = self.compute(text)
        if len(text) <= WORTH:
            if self.held > REMEMBERED:
                self.clear()
                self.held = 0
            self[text] = found
            self.held += ENTRY + len(text)
        return found


def let_go() -> None:
    """Hand memory freed at the end of a task back to the system: Spark's Python workers live on,
    and what one stage leaves behind would add to the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # not this C library: nothing to trim
    _libc = None


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings, and once per application the package itself for the executors' Python."""
    session.configure(spark)
    # Texts are long: fewer rows per Arrow batch keep both sides of the exchange small.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(session.__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="storepulse-")) / "storepulse.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by their exact spelling.

    Other columns are dropped, so names of theirs that differ only in case, hold dots or
    equal a helper column cannot clash with anything later on.
    """
    places = [f"c{i}" for i in range(len(df.columns))]
    found = [df.columns.index(n) for n in names]
    return df.toDF(*places).select(*(F.col(places[i]).alias(n) for i, n in zip(found, names)))


def tucked(df: DataFrame, **taken: str) -> DataFrame:
    """`row`, a struct of all columns as they were, and the columns in `taken` under new names.

    Helper columns can then be added freely; `row.*` gives the rows back unchanged.
    """
    places = [f"c{i}" for i in range(len(df.columns))]
    row = F.struct(*(F.col(p).alias(name) for p, name in zip(places, df.columns)))
    return df.toDF(*places).select(
        row.alias("row"), *(F.col(places[df.columns.index(name)]).alias(new) for new, name in taken.items())
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and all
    run on this machine (tests). Executors elsewhere would not see what the driver reads."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="storepulse-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = StructType.fromJson(df.schema.jsonValue())
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that Python holds few rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list column from concatenated values and the length of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def gathered(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places begins[i], begins[i] + 1, ... of sizes[i] elements each, laid end to end."""
    stops = sizes.cumsum()
    total = int(stops[-1]) if len(stops) else 0
    kind = np.int32 if total < 1 << 31 and (not len(begins) or begins.max() < 1 << 30) else np.int64
    return np.arange(total, dtype=kind) + np.repeat((begins - (stops - sizes)).astype(kind), sizes)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components by hooking and pointer jumping.

    edges: (a long, b long), any direction, repeats allowed. Returns (id, component): every
    id of an edge with the smallest id it can reach. Each round lets every id take the
    smallest label of its neighbours and then the label of that label, so long chains
    shorten by about half per round. Labels are written after every round; only two counts
    reach the driver. A hub's neighbours are combined on the map side.
    """
    both = edges.select("a", "b").filter("a <> b")
    links = stored(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    lowest = links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low"))
    labels = stored(lowest.select("id", F.least("id", "low").alias("component")), name)
    while True:
        near = (
            links.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        )
        hooked = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("low"))
        # Whoever points at a label follows it to that label's own new label.
        follow = hooked.select(F.col("id").alias("low"), F.col("low").alias("jump"))
        # The old root of a moved id moves with it.
        roots = hooked.filter("low < component").groupBy(F.col("component").alias("id")).agg(F.min("low").alias("pulled"))
        new = stored(
            hooked.join(follow, "low", "left").join(roots, "id", "left")
            .select("id", F.col("component").alias("old"), F.least("low", "jump", "pulled").alias("component")),
            name,
        )
        if new.filter("component <> old").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")
