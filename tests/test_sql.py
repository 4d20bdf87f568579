"""Every query that has SQL equals it on the shared tables."""

import duckdb
import pytest

import __spark_entry__ as driver
from checks.run import TABLES, canonical, fetched
from tests.conftest import SF

SQL = driver.oracle_sql()
QUERIES = driver.queries()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, sf, name):
    got, want = fetched(QUERIES[name](spark, sf)), db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_runs(spark):
    assert driver.entry(spark).count() > 0
