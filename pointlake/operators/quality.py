"""Data checks of scans and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointlake.functions.labels import NAMES, THINGS
from pointlake.functions.numerics import finite
from pointlake.schema import frame_keys


def invalid_labels(points: DataFrame) -> DataFrame:
    """semantic_id, n of ids that the ontology lacks."""
    known = points.sparkSession.createDataFrame([(i,) for i in NAMES], "semantic_id int")
    return points.groupBy("semantic_id").agg(F.count("*").alias("n")).join(F.broadcast(known), "semantic_id", "left_anti")  # 34 rows


def count_mismatch(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Frames whose point and label counts differ, those on one side alone included: frame, points, labels."""
    keys = frame_keys(points)
    p = points.groupBy(*keys).agg(F.count("*").alias("points"))
    q = labels.groupBy(*keys).agg(F.count("*").alias("labels"))
    return p.join(q, keys, "full").fillna(0, ["points", "labels"]).where("points <> labels")


def frame_checks(points: DataFrame) -> DataFrame:
    """frame, failed: the first check that a frame fails (non_finite, then invalid_label); passing frames have no row."""
    keys = frame_keys(points)
    bad = ~finite(F.col("x"), F.col("y"), F.col("z"))
    seen = points.groupBy(*keys).agg(F.max(bad.cast("int")).alias("_a"), F.max((~F.coalesce(F.col("semantic_id").isin(*NAMES), F.lit(True))).cast("int")).alias("_b"))
    failed = F.when(F.col("_a") == 1, F.lit("non_finite")).when(F.col("_b") == 1, F.lit("invalid_label"))
    return seen.select(*keys, failed.alias("failed")).where("failed IS NOT NULL")


def file_checks(info: DataFrame) -> DataFrame:
    """The same from file sizes: frame_id, failed (scan_size, label_size, count_mismatch)."""
    failed = F.when(F.expr("scan_bytes % 16 <> 0"), F.lit("scan_size")).when(F.expr("label_bytes % 4 <> 0"), F.lit("label_size")).when(F.expr("labels <> points"), F.lit("count_mismatch"))
    return info.select("frame_id", failed.alias("failed")).where("failed IS NOT NULL")


def instance_continuity(points: DataFrame, pairs: int = 10) -> DataFrame:
    """One row: shared, total, rate and passed over at most ``pairs`` evenly spaced neighbouring frames.

    Instances count if their id is not 0 and their class countable. The rate is shared instances over
    those of the earlier frames; under one half fails. Without instances the rate is 1.
    """
    seen = points.where((F.col("instance_id") != 0) & F.col("semantic_id").isin(*THINGS)).select("frame_id", "instance_id").distinct()
    frames = points.select("frame_id").distinct()
    order = Window.orderBy("frame_id")
    ranked = frames.select("frame_id", (F.row_number().over(order) - 1).alias("at"), F.lead("frame_id").over(order).alias("after"))
    count = frames.agg(F.count("*").alias("n"))
    last = F.col("n") - 2  # ordinal of the last pair
    i = F.ceil(F.col("at") * (pairs - 1) / F.greatest(last, F.lit(1)))
    sampled = ranked.crossJoin(count).where("after IS NOT NULL").where((F.col("n") - 1 <= pairs) | (F.floor(i * last / (pairs - 1)) == F.col("at"))).select("frame_id", "after")
    later = seen.select(F.col("frame_id").alias("after"), "instance_id", F.lit(1).alias("_hit"))
    hit = seen.join(sampled, "frame_id").join(later, ["after", "instance_id"], "left")
    rate = F.coalesce(F.try_divide(F.col("shared").cast("double"), F.col("total").cast("double")), F.lit(1.0))
    return hit.agg(F.count("_hit").alias("shared"), F.count("*").alias("total")).withColumn("rate", rate).withColumn("passed", F.col("rate") >= 0.5)


def prediction_checks(expected: DataFrame, found: DataFrame) -> DataFrame:
    """frame_id, problem: missing, unexpected or point_count, of frames (frame_id, points) that should have a prediction."""
    both = expected.select("frame_id", F.col("points").alias("want")).join(found.select("frame_id", F.col("points").alias("have")), "frame_id", "full")
    problem = F.when(F.col("have").isNull(), F.lit("missing")).when(F.col("want").isNull(), F.lit("unexpected")).when(F.col("want") != F.col("have"), F.lit("point_count"))
    return both.select("frame_id", problem.alias("problem")).where("problem IS NOT NULL")


def structure_checks(spark: SparkSession, root: str, sequence: str, require_poses: bool = False) -> list[tuple[str, bool]]:
    """(part, present) of a sequence directory; scans are required, poses on request for sequences up to 10, the rest is optional."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/sequences/{sequence.zfill(2)}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda name: store.exists(spark._jvm.org.apache.hadoop.fs.Path(path, name))
    out = [("velodyne", there("velodyne")), ("labels", there("labels")), ("calib.txt", there("calib.txt")), ("poses.txt", there("poses.txt"))]
    if not out[0][1] or (require_poses and int(sequence) <= 10 and not out[3][1]):
        raise FileNotFoundError(f"sequence {sequence} lacks {'velodyne' if not out[0][1] else 'poses.txt'}")
    return out
