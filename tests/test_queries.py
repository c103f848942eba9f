"""Every registered query against its SQL in DuckDB, on the smallest test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver

pytestmark = pytest.mark.skipif(not os.path.isdir(driver.SMOKE_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in driver.TABLES:
        path = f"{driver.SMOKE_DIR}/{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def sorted_rows(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([row[i] for i in order]) for row in rows)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = driver.queries()[name](spark, driver.SMOKE_DIR)
    expected = duck.execute(driver.oracle_sql()[name])
    names = [column[0] for column in expected.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted_rows(df.collect(), df.columns) == sorted_rows(expected.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - set(driver.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert not driver.queries()[name](spark, driver.SMOKE_DIR).isEmpty()


def test_every_sql_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_flagship(spark):
    df = driver.entry(spark)
    assert {"order_key", "line_num", "price_usd", "line_hash", "l_shipdate"} <= set(df.columns) and len(df.columns) == 12
    assert df.count() > 0
