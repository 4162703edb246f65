"""Every registered query against its SQL."""

import pytest

from pointlake.plans import catalogue
from tests.oracle import HAVE, SF, rows_equal

pytestmark = pytest.mark.skipif(not HAVE, reason="no benchmark tables")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    rows_equal(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_entry(spark):
    assert catalogue.entry(spark, SF).count() > 0


def test_entry_module():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
