"""Queries whose rows depend on floats at a bound or on many frames, against their SQL on ten times the rows."""

import os

import pytest

from pointlake.plans import catalogue
from tests.oracle import SF_MORE, rows_equal

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_MORE), reason="no benchmark tables")


@pytest.mark.parametrize("name", ["iou_histogram", "match_frames", "instance_continuity", "semantic_summary_by_distance"])
def test_query_equals_sql(spark, name):
    assert rows_equal(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SF_MORE) > 0
