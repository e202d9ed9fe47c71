"""Every registered query against its SQL on the smallest driver tables."""

import os

import pytest

from check_oracle import compare, connect
from wayledger.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    result = compare(spark, con, name, SF)
    assert result.startswith("ok" if name in ORACLES else "rows-only"), result


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
