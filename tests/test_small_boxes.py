"""Labels from boxes of few points."""

from datetime import datetime

from pointlake.plans import catalogue

NAMES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def test_boxes_of_fewer_than_thirty_points_give_labels(spark, tmp_path):
    day = datetime(2000, 1, 1)
    corners = [(d, t, q) for d in (0.0, 0.1) for t in (0.0, 0.08) for q in (1.0, 50.0)]
    rows = [(1, 5, 0, i, q, 750.0, d, t, "N", "O", day) for i, (d, t, q) in enumerate([*corners, (0.05, 0.04, 25.0)])]
    spark.createDataFrame(rows, NAMES).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.frame_id, r.class_id): r.n for r in catalogue.boxes_to_labels(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 8, (0, 30): 1}
