"""Every query with a SQL equivalent, against that SQL."""

import pytest

import __spark_entry__ as entry
from tests.compare import differences, duck

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_statement_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, con, name):
    actual = entry.queries()[name](spark, sf_dir).toArrow()
    assert differences(actual, con.sql(SQL[name]).to_arrow_table()) == []


def test_entry(spark):
    assert entry.entry(spark).count() == 15
