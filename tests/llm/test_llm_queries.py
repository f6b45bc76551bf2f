import duckdb
import pytest

from cohortry.llm import queries
from verify import canonical, oracle_rows, rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    connection = duckdb.connect()
    for view in ("documents", "pages", "embeddings"):
        connection.execute(f"CREATE VIEW {view} AS SELECT * FROM '{FOLDER}/{view}.parquet'")
    got, want = rows_of(queries.queries()[name](spark, FOLDER)), oracle_rows(connection, queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_one_query_for_each_operator():
    assert [name.split("_")[0] for name in queries.queries()] == [f"op{n}" for n in range(1, 14)]
