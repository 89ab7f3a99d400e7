"""Every query with a SQL twin gives the twin's rows; every other query runs and has a stable schema."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import rows_of

QUERIES, SQL = entry.queries(), entry.oracle_sql()
NAMES = sorted({id(f): name for name, f in sorted(QUERIES.items(), reverse=True)}.values())  # a query may have several names


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    if name not in SQL:
        assert df.columns
        return
    c = con.execute(SQL[name])
    columns = [d[0] for d in c.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, got) == rows_of(columns, c.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 2


def test_no_twin_without_a_query():
    assert set(SQL) <= set(QUERIES)
