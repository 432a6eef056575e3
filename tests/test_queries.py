"""Every registered query, against its SQL where it has one."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from oracle import connect, difference

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, duck, name):
    assert difference(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    result = QUERIES[name](spark, sf_dir)
    assert result.count() > 0
    assert len(set(result.columns)) == len(result.columns)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.columns[0] == "user_session"
    assert result.count() > 0
