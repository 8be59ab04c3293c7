"""Every query with a SQL twin, compared cell by cell; set ORACLE_DIR for another scale."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

SF = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    problem, _ = difference(entry.queries()[name](spark, SF), con, SQL[name])
    assert problem is None


def test_entry(spark):
    assert entry.entry(spark).count() == 50
