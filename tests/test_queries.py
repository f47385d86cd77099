"""Every registered catalog query against its SQL on the smallest tables."""

import os

import pytest

from shelfspark import catalog_queries as q

from .oracle import connect, same

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, con, name):
    df = q.QUERIES[name](spark, SF)
    if name in q.ORACLES:
        same(df, con, q.ORACLES[name])
    else:
        assert df.count() >= 0
