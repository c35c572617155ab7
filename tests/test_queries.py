"""Every registered query against its SQL on the smallest tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from workload.fixtures import SPARK_VIEWS, VIEWS
from workload.registry import BASE_TABLES, ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(repr(tuple(r[i] for i in order)) for r in cursor.fetchall())
    assert got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SPARK_VIEWS))
def test_views_of_few_columns_have_the_same_rows(spark, name):
    lines = spark.createDataFrame(
        [(o, p, s) for o in (1, 2, None) for p in (*range(1, 60), None) for s in ("O", "F", "X", None) for _ in range(2)],
        "l_orderkey long, l_partkey long, l_linestatus string",
    )
    lines.createOrReplaceTempView("lineitem")
    plain, few = spark.sql(VIEWS[name]), spark.sql(SPARK_VIEWS[name])
    spark.catalog.dropTempView("lineitem")
    assert plain.columns == few.columns and plain.count() == few.count() == few.distinct().count()
    assert plain.exceptAll(few).count() == 0
    keys = re.search(r"Aggregate \[([^\]]*)\]", few._jdf.queryExecution().optimizedPlan().toString())[1]
    assert "DR-" not in keys and "dr_id" not in keys
