"""The registered queries of the training-data operators against their SQL."""

import pytest

from pointlake.llm import oracle, queries
from tests.oracle import HAVE, rows_equal

pytestmark = pytest.mark.skipif(not HAVE, reason="no benchmark tables")


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert rows_equal(spark, queries.QUERIES[name], oracle.ORACLE_SQL[name]) > 0
