"""Every query with a SQL twin gives the same rows as DuckDB."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_module

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_same_rows(spark, con, sf_dir, key):
    assert compare(QUERIES[key](spark, sf_dir), con, ORACLES[key]) is None


def test_entry(spark):
    assert entry_module.entry(spark).count() == 19
