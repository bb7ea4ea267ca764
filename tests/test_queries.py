"""Every registered query with a DuckDB text, compared on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from binflow.bindings import BASE_TABLES

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"create view {table} as select * from '{small}/{table}.parquet'")
    return con


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(str(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(name, spark, duck, small):
    got = queries()[name](spark, small).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(ORACLES)))
def test_gives_rows(name, spark, small):
    assert queries()[name](spark, small).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 6
