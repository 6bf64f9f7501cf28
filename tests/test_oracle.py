"""Every registered query of the package against its DuckDB twin on the smallest tables."""

import pytest

from gleaner.plans import registry
from tests.compare import assert_same, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_duckdb(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
