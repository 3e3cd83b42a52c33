"""Each query of the catalog against its SQL, over the smallest of the given tables."""

import oracle
import pytest

from siftwell.plans import catalog


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@oracle.there
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_and_sql(spark, con, name):
    got, want = oracle.both(spark, con, catalog.QUERIES[name], catalog.SQL[name])
    assert got == want
