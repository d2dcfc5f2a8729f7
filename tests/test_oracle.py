"""Every registered query against its SQL on the smallest stock tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect
from trafficlens.catalog.oracle import ORACLE
from trafficlens.catalog.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, name) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
