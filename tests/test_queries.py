"""Registered queries against their SQL on the smallest tables, and streams against batch."""

import os

import pytest

import __spark_entry__ as E
from checks.compare import connect, difference

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_statement_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql())))
def test_query_equals_sql(spark, con, name):
    assert difference(E.queries()[name](spark, SF).toPandas(), con.execute(E.oracle_sql()[name]).df()) == ""


def test_entry(spark):
    assert E.entry(spark).count() == 5
