"""Every registered query against its SQL; those without SQL give rows."""

import compare
import pytest

import __spark_entry__  # noqa: F401
from tidewater.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return compare.views(compare.DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert compare.difference(QUERIES[name](spark, compare.DATA), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, compare.DATA).count() > 0
