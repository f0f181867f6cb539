"""Every query with SQL against DuckDB, as written: whole values, nothing rounded beyond the query's own rounding; the others run."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tidewatch.sources.tables import TABLES

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = entry.catalog()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 51


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
