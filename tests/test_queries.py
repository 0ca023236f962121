"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from compare import connect, mismatch

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert mismatch(spark, con, sf_dir, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_gives_the_known_count(spark):
    assert entry_points.entry(spark).count() == 385


def test_no_sql_without_query():
    assert set(ORACLES) <= set(QUERIES)
