"""The training-data queries: those with SQL against DuckDB on the smallest tables; the others must run and hold their invariants."""

import os

import duckdb
import pytest

from turnweave.llm import queries as llm

SF = "/root/testdata/sf0.001"
QUERIES, SQL = llm.queries(), llm.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return connection


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    rows = found.collect()
    if name not in SQL:
        assert rows or name == "p8_proximity"
        return
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    at = [columns.index(c) for c in sorted(columns)]
    want = sorted(str(tuple(r[k] for k in at)) for r in result.fetchall())
    assert sorted(str(tuple(r[c] for c in sorted(found.columns))) for r in rows) == want
