"""Queries with SQL against DuckDB on the smallest tables."""

import os

import pytest

from shelfspark.llm import queries as q
from tests.oracle import connect, same

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query(spark, name):
    same(q.QUERIES[name](spark, SF), connect(SF), q.ORACLES[name])
