"""Every registered query against its SQL twin, on the smallest data folder."""

import pytest
from helpers import plan
from oracle_compare import compare, connect

from storepulse.plans import oracle, registry

FOLDER = "/root/testdata/sf0.001"
QUERIES = registry.queries()
SQL = oracle.oracle_sql()
@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    text = plan(df)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    # Every query stays in the JVM.
    assert "Pandas" not in text and "Python" not in text and "Arrow" not in text
    got = df.toPandas()
    described = duck.execute(f"describe {SQL[name]}").fetchall()
    assert compare(df.schema, got, described, duck.execute(SQL[name]).df()) == ""


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["week", "revenue"]
    assert df.count() > 300
