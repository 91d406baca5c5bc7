"""Every registered query with SQL against DuckDB on the smallest tables; the others run and return rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as spark_entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows_of(pdf, cols):
    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 4) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted((tuple(norm(v) for v in r) for r in pdf[cols].itertuples(index=False)), key=repr)


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 5


def test_sql_has_a_query_each():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", sorted(spark_entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = spark_entry.queries()[name](spark, DATA).toPandas()
    want = duck.sql(spark_entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert rows_of(got, cols) == rows_of(want, cols)
