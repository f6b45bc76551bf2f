"""Every registered query against its check SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from verify import TABLES, canonical, oracle_rows, rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


# queries of the training-data operators have tests of their own
OWN = sorted(name for name in entry.queries() if name != "pipeline" and not name.startswith("op"))


def test_every_query_has_a_check():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(OWN) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["cohort", "value"]


@pytest.mark.parametrize("name", OWN)
def test_query(spark, tables, name):
    got = rows_of(entry.queries()[name](spark, FOLDER))
    want = oracle_rows(tables, entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
