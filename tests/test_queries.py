"""Every registered query that SQL can express, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from sparray import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def comparable(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, sf, duck, name):
    got = core.queries()[name](spark, sf)
    columns = sorted(got.columns)
    rows = [tuple(comparable(r[c]) for c in columns) for r in got.collect()]
    assert rows
    found = duck.sql(core.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = [tuple(comparable(r[i]) for i in at) for r in found.fetchall()]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
