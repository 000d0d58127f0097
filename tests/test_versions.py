"""Tables that survive failed and killed writes."""

import contextlib
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from storepulse.sources import sinks
from storepulse.sources.versions import VersionedTable

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ids(df):
    return sorted(r.id for r in df.collect())


def failing(spark, n=8):
    """Most partitions can be written, the last one raises."""
    @F.udf("long")
    def fail_late(i):
        if i >= n - 1:
            raise RuntimeError("broken input")
        return i

    return spark.range(0, n, 1, n).select(fail_late("id").alias("id"))


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    tables = sinks.Tables(spark, str(tmp_path))
    tables.save("marts", "t", spark.range(5))
    with pytest.raises(Exception, match="broken input"):
        tables.save("marts", "t", failing(spark))
    assert ids(sinks.Tables(spark.newSession(), str(tmp_path)).get("marts", "t")) == [0, 1, 2, 3, 4]
    tables.save("marts", "t", spark.range(2))
    assert ids(tables.get("marts", "t")) == [0, 1]
    table = tables.table("marts", "t")
    assert [v.number for v in table.versions()] == [1, 2]
    left = os.listdir(f"{table.path}/data")
    assert len(left) == 3 and len(table.remove_abandoned(0.0)) == 1
    assert table.remove_abandoned(0.0) == [] and ids(table.read()) == [0, 1]


JOB = """
import sys, time
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from storepulse.session import local_session
from storepulse.sources import sinks

spark = local_session(cpus=4, app="killed-write")

@F.udf("long")
def slow(i):
    if i % 2:
        open({marker!r} + str(i), "w").close()
        time.sleep(600)
    return i

sinks.Tables(spark, {folder!r}).save("marts", "t", spark.range(0, 4, 1, 4).select(slow("id").alias("id")))
"""


def test_a_killed_job_leaves_the_table(spark, tmp_path):
    folder, marker = str(tmp_path / "tables"), str(tmp_path / "half-")
    sinks.Tables(spark, folder).save("marts", "t", spark.range(5))
    job = subprocess.Popen(
        [sys.executable, "-c", JOB.format(root=ROOT, marker=marker, folder=folder)], stdout=subprocess.DEVNULL,
        stderr=subprocess.DEVNULL, start_new_session=True)
    try:
        for _ in range(600):
            if os.path.exists(marker + "1") and os.path.exists(marker + "3"):
                break
            assert job.poll() is None
            time.sleep(0.1)
        time.sleep(1.0)  # the other half of the tasks finishes its files
        assert len(os.listdir(f"{folder}/marts/t/data")) == 2
    finally:
        with contextlib.suppress(ProcessLookupError):
            os.killpg(job.pid, 9)  # the job's own group: it, its JVM and its workers
        job.wait()
    later = sinks.Tables(spark.newSession(), folder)
    assert ids(later.get("marts", "t")) == [0, 1, 2, 3, 4] and len(later.table("marts", "t").versions()) == 1
    later.save("marts", "t", spark.range(3))
    assert ids(sinks.Tables(spark, folder).get("marts", "t")) == [0, 1, 2]


def test_readers_stay_on_their_version(spark, tmp_path):
    tables = sinks.Tables(spark, str(tmp_path))
    first = tables.save("marts", "t", spark.range(5))
    second = tables.save("marts", "t", spark.range(7))
    assert ids(first) == list(range(5)) and ids(second) == list(range(7))
    assert ids(tables.get("marts", "t", version=1)) == list(range(5))
    tables.save("marts", "t", spark.range(9))
    assert ids(second) == list(range(7)) and len(os.listdir(f"{tables.path('marts', 't')}/data")) == 2
    with pytest.raises(ValueError):
        tables.get("marts", "t", version=17)


def test_a_table_may_be_rebuilt_from_itself(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.write(spark.range(4))
    table.write(table.read().filter("id > 1"))
    table.write(table.read().limit(0))
    assert table.read().columns == ["id"] and table.read().count() == 0


def test_writers_at_once_agree_on_the_last(spark, tmp_path):
    a, b = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    a.write(spark.range(1))
    both = [(t._fill(spark.range(n), ()), t) for t, n in ((a, 2), (b, 3))]
    from storepulse.sources.versions import Version
    done = [t._finish(Version(number, token, ((folder, None),))) for (number, token, folder), t in both]
    assert a.current() == b.current() == max(done) and len(a.versions()) == 3


def test_a_plain_folder_is_still_read(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "marts" / "old"))
    tables = sinks.Tables(spark, str(tmp_path))
    assert ids(tables.get("marts", "old")) == [0, 1, 2]


def test_partitions_are_replaced_and_shared(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    rows = spark.range(30).selectExpr("id", "cast(id % 3 as int) as part", "cast(id % 2 as int) as half")
    table.write(rows, ["part", "half"])
    new = spark.range(100, 104).selectExpr("id", "1 as part", "cast(id % 2 as int) as half")
    version = table.replace_partitions(new, [{"part": 1, "half": 0}, {"part": 1, "half": 1}, {"part": 2, "half": 0}])
    want = [i for i in range(30) if i % 3 != 1 and not (i % 3 == 2 and i % 2 == 0)] + [100, 101, 102, 103]
    assert ids(table.read()) == sorted(want) and ids(table.read(1)) == list(range(30))
    assert len(version.parts) == 2 and table.remove_old(1) == []
    assert dict(table.read().dtypes) == dict(rows.dtypes)
    table.replace_partitions(new.limit(0), [{"part": 0, "half": h} for h in (0, 1)])
    assert ids(table.read()) == sorted(i for i in want if i >= 100 or i % 3)
    with pytest.raises(ValueError, match="outside"):
        table.replace_partitions(new, [{"part": 1, "half": 0}])
    assert ids(table.read()) == sorted(i for i in want if i >= 100 or i % 3)
    with pytest.raises(ValueError, match="no partitioned"):
        VersionedTable(spark, str(tmp_path / "u")).replace_partitions(new, [])
