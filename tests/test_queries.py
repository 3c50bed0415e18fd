"""Every registered query with SQL, against DuckDB, on a small scale: all sessions of the log."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
LIBRARY = __import__("runline.jobs.registry", fromlist=["x"])


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(LIBRARY.oracle_sql()))
def test_query(spark, duck, name):
    df = LIBRARY.queries()[name](spark, SF)
    found = duck.execute(LIBRARY.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, map(tuple, df.collect())) == rows_of(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(LIBRARY.queries()) - set(LIBRARY.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    df = LIBRARY.queries()[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
