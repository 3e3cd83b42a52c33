"""The operators that SQL can express against their SQL, over the smallest of the given tables."""

import oracle
import pytest

from siftwell.llm import queries


@oracle.there
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_operator_and_sql(spark, name):
    got, want = oracle.both(spark, oracle.connect(), queries.QUERIES[name], queries.SQL[name])
    assert got == want and got
