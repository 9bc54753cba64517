"""Every registered query against its SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from sheetscope.plans.base import SCHEMAS

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in SCHEMAS:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{ROOT}/{table}.parquet'")
    return connection


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, duck, name):
    mine = entry.queries()[name](spark, ROOT).toArrow()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert mine.num_rows > 0
        return
    theirs = duck.execute(sql).fetch_arrow_table() if hasattr(duck, "fetch_arrow_table") else duck.sql(sql).to_arrow_table()
    columns = sorted(mine.column_names)
    assert columns == sorted(theirs.column_names)
    values = lambda table: sorted(repr(tuple(row[c] for c in columns)) for row in table.to_pylist())
    assert values(mine) == values(theirs)
