"""Parquet tables that are replaced as a whole or not at all.

A table's folder holds `data/<version>` folders, which never change once written, and a log
in `versions`: small files, one row per finished version. A write fills a new data folder
and then appends its row; Spark's committer makes that row appear at once or not at all. A
job that dies before leaves the table as it was, and readers of an older version go on
reading it until it is removed.

A version is a list of parts: a data folder, whole or some partition folders of it. So a new
version can share all unchanged partitions with the one before.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "version long, token string, parts array<struct<folder: string, partitions: array<string>>>, partition_by array<string>"


@dataclass(frozen=True, order=True)
class Version:
    """Two writers at once may finish under one number; the token then decides, the same for all readers."""

    number: int
    token: str
    parts: tuple[tuple[str, tuple[str, ...] | None], ...] = ()
    partition_by: tuple[str, ...] = ()


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def versions(self) -> list[Version]:
        """Finished versions, oldest first."""
        try:
            rows = self.spark.read.schema(LOG).json(f"{self.path}/versions").collect()
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in (err.getCondition() or ""):
                raise
            return []
        return sorted(
            Version(r.version, r.token, tuple((p.folder, None if p.partitions is None else tuple(p.partitions)) for p in r.parts),
                    tuple(r.partition_by or ()))
            for r in rows
        )

    def current(self) -> Version | None:
        return max(self.versions(), default=None)

    def folders(self, version: Version | None = None) -> list[str]:
        """Data folders that a version reads."""
        version = version or self.current()
        return [f"{self.path}/data/{folder}" for folder, _ in version.parts] if version else []

    def _fill(self, df: DataFrame, partition_by: Sequence[str]) -> tuple[int, str, str]:
        last = self.current()
        number, token = (last.number + 1 if last else 1), uuid.uuid4().hex
        folder = f"{number:08d}-{token}"
        if partition_by:
            # Spark rebalances and also splits a partition value that holds far more rows than the others.
            df = df.hint("rebalance", *partition_by)
            df.write.partitionBy(*partition_by).parquet(f"{self.path}/data/{folder}")
        else:
            df.write.parquet(f"{self.path}/data/{folder}")
        return number, token, folder

    def _finish(self, version: Version) -> Version:
        row = (version.number, version.token, list(version.parts), list(version.partition_by))
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").json(f"{self.path}/versions")
        return version

    def write(self, df: DataFrame, partition_by: Sequence[str] = ()) -> Version:
        """Replace the table. `df` may read the table itself."""
        number, token, folder = self._fill(df, partition_by)
        return self._finish(Version(number, token, ((folder, None),), tuple(partition_by)))

    def replace_partitions(self, df: DataFrame, values: Sequence[Mapping[str, object]]) -> Version:
        """A new version in which the partitions given by `values` hold the rows of `df` alone.

        `df` must have no rows of other partitions; a partition without rows in it becomes
        empty. All other partitions are shared with the version before.
        """
        last = self.current()
        if last is None or not last.partition_by:
            raise ValueError(f"{self.path} has no partitioned version to change")
        columns = last.partition_by
        gone = {self._partition(columns, v) for v in values}
        number, token, folder = self._fill(df, columns)
        added = tuple(sorted(self._partitions(folder, columns)))
        if stray := set(added) - gone:
            raise ValueError(f"rows outside the replaced partitions: {sorted(stray)[:3]}")
        parts = []
        for old, some in last.parts:
            left = tuple(p for p in (self._partitions(old, columns) if some is None else some) if p not in gone)
            if left:
                parts.append((old, tuple(sorted(left))))
        # The new folder stays a part even when empty: it carries the schema.
        return self._finish(Version(number, token, (*parts, (folder, added)), columns))

    @staticmethod
    def _partition(columns: Sequence[str], value: Mapping[str, object]) -> str:
        return "/".join(f"{c}={'__HIVE_DEFAULT_PARTITION__' if value[c] is None else value[c]}" for c in columns)

    def _partitions(self, folder: str, columns: Sequence[str]) -> list[str]:
        """Partition folders of a data folder, found level by level."""
        found = [""]
        for c in columns:
            found = [
                f"{f}/{name}" if f else name
                for f in found for name in self._children(f"{self.path}/data/{folder}/{f}".rstrip("/")) if name.startswith(f"{c}=")
            ]
        return found

    def read(self, version: Version | int | None = None) -> DataFrame:
        """The rows of a version, the last one by default. What is read does not change when
        the table is written again."""
        if isinstance(version, int):
            version = max((v for v in self.versions() if v.number == version), default=None)
            if version is None:
                raise ValueError(f"{self.path} has no such version")
        version = version or self.current()
        if version is None:
            return self.spark.read.parquet(self.path)  # a plain Parquet folder, written without versions
        frames = []
        for folder, some in version.parts:
            base = f"{self.path}/data/{folder}"
            if some is None:
                frames.append(self.spark.read.parquet(base))
            elif some:
                frames.append(self.spark.read.option("basePath", base).parquet(*(f"{base}/{p}" for p in some)))
        if not frames:
            return self.spark.read.parquet(f"{self.path}/data/{version.parts[-1][0]}")
        return reduce(DataFrame.unionByName, frames)

    def remove_old(self, keep: int = 2) -> list[str]:
        """Delete data folders that none of the last `keep` versions reads; returns their names."""
        versions = self.versions()
        used = {folder for v in versions[-max(keep, 1):] for folder, _ in v.parts}
        gone = sorted({folder for v in versions for folder, _ in v.parts} - used)
        return [folder for folder in gone if self._delete(f"{self.path}/data/{folder}")]

    def remove_abandoned(self, older_than_hours: float = 24.0) -> list[str]:
        """Delete data folders that no finished version names and that are older than any running write."""
        named = {folder for v in self.versions() for folder, _ in v.parts}
        limit = (time.time() - 3600 * older_than_hours) * 1000
        gone = [name for name, changed in self._children(f"{self.path}/data").items() if name not in named and changed <= limit]
        return [name for name in gone if self._delete(f"{self.path}/data/{name}")]

    # Spark itself lists and deletes no folders; its Hadoop file systems do, whatever the store.

    def _file_system(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _children(self, path: str) -> dict[str, int]:
        files, place = self._file_system(path)
        if not files.exists(place):
            return {}
        return {s.getPath().getName(): s.getModificationTime() for s in files.listStatus(place) if s.isDirectory()}

    def _delete(self, path: str) -> bool:
        files, place = self._file_system(path)
        return bool(files.delete(place, True))
