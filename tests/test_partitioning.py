from bisect import bisect_right

from pyspark.sql import functions as F

from pointlake.operators.partitioning import cut_points, deal, murmur3_int, range_index, slot_keys


def test_each_key_goes_to_its_slot(spark):
    for n in (1, 7, 211):
        assert [murmur3_int(k) % n for k in slot_keys(n)] == list(range(n))
    rows = deal(spark.range(500), F.pmod("id", F.lit(9)).cast("int"), 9).select("id", F.spark_partition_id().alias("p")).collect()
    assert all(r.p == r.id % 9 for r in rows)


def test_range_index_is_bisect(spark):
    for cuts in ([], [5], [1, 4], [0, 10, 20, 30, 40], list(range(0, 211 * 3, 3))):
        got = spark.range(-2, 650).select("id", range_index(F.col("id"), cuts).alias("i")).collect()
        assert all(r.i == bisect_right(cuts, r.id) for r in got)
    assert spark.sql("SELECT cast(null AS bigint) AS k").select(range_index(F.col("k"), [1, 2]).alias("i")).first().i == 0


def test_cut_points_balance(spark):
    cuts = cut_points(spark.range(1000), "id", 4)
    assert len(cuts) == 3 and all(abs(c - w) <= 2 for c, w in zip(cuts, (249, 499, 749), strict=True))
