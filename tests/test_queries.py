"""Every registered query against its SQL in DuckDB; rows only where it has none."""

import pytest

from suite import oracle, queries
from suite.compare import compare

SF = "/root/testdata/sf0.001"
SQL = oracle.all_sql()
QUERIES = queries.all_queries()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    pytest.importorskip("duckdb")
    rows, problem = compare(spark, SF, QUERIES[name], SQL.get(name))
    assert problem is None, problem
    assert rows > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
