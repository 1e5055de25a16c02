"""Every registered query against its DuckDB twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from augurmill.oracle.compare import compare, duck

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    message = compare(QUERIES[name](spark, sf), ORACLE.get(name), con)
    assert message.startswith(("ok", "rows-only")), message


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["model_id", "venue"]
