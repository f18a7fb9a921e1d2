"""Operators against their DuckDB counterparts, on whole tables."""

import compare
import pytest

from webcorpus.llm.oracles import ORACLES
from webcorpus.llm.queries import QUERIES

TABLES = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert compare.differences(QUERIES[name](spark, TABLES), compare.connection(TABLES), ORACLES[name]) == []
