"""Every registered query against DuckDB on the driver's smallest tables."""

import os

import pytest

from tests.compare import connect, differences
from workload import oracle, registry

SF = "/root/testdata/sf0.001"
SQL = oracle.sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(SQL) == set(registry.QUERIES)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    assert differences(registry.QUERIES[name](spark, SF), duck, SQL[name]) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["aircraft_model", "total_flights"]
