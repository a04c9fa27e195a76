"""Rows written by hand for one small policy."""

import duckdb
import pytest

from tests.policy_goldens import ORACLES, QUERIES
from tests.test_queries import canonical


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_golden(spark, name):
    assert canonical(QUERIES[name](spark, "").toPandas()) == canonical(duckdb.sql(ORACLES[name]).df())
