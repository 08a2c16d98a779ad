"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import pytest

import __spark_entry__ as entry
from suite.check import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, duck, name):
    assert compare(spark, duck, SF, entry.queries()[name], ORACLES[name]).startswith("ok")


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 11
