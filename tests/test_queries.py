"""Every registered query against its SQL counterpart on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry_points
from tests.compare import connect, differences

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry_points.queries()
ORACLE = entry_points.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data is not mounted")


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, DATA), duck, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_without_sql_has_rows(spark, name):
    assert not QUERIES[name](spark, DATA).isEmpty()


def test_entry_has_rows(spark):
    assert not entry_points.entry(spark).isEmpty()
