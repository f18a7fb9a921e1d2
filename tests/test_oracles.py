"""Every registered query against its DuckDB counterpart on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry_points
from webcorpus.catalog.oracles import ORACLES
from webcorpus.catalog.queries import QUERIES

NAMES = sorted(QUERIES)


def test_every_query_has_a_counterpart():
    assert NAMES == sorted(ORACLES)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.fixture(scope="module")
def con(sf):
    return compare.connection(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    assert compare.differences(entry_points.queries()[name](spark, sf), con, entry_points.oracle_sql()[name]) == []


def test_entry(spark):
    assert entry_points.entry(spark).count() == 11
