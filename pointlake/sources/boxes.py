"""Box files: JSON lines of frames and flat Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointlake.schema import FLAT_BOX, FRAME_BOXES


def nested(flat: DataFrame) -> DataFrame:
    """Flat boxes as one row a frame with boxes sorted by box_id."""
    box = F.struct(
        "box_id",
        F.array("center_x", "center_y", "center_z").alias("center"),
        F.array("extent_x", "extent_y", "extent_z").alias("extent"),
        "yaw",
        F.array("length", "width", "height").alias("dimensions"),
        "volume",
        F.col("num_points").cast("int").alias("num_points"),
        F.coalesce("score", F.lit(1.0)).alias("score"),
        F.coalesce("semantic_id", F.lit(0)).alias("semantic_id"),
        F.coalesce("valid", F.lit(True)).alias("valid"),
        F.coalesce("cluster_id", F.lit(-1)).cast("int").alias("cluster_id"),
    )
    frames = flat.groupBy("frame_id").agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    return frames.select("frame_id", F.size("boxes").alias("num_boxes"), F.size(F.filter("boxes", lambda b: b["valid"])).alias("num_valid_boxes"), "boxes")


def flattened(frames: DataFrame) -> DataFrame:
    """One row a box; missing score, semantic_id, valid and cluster_id get 1, 0, true and -1. Frames without boxes give no rows."""
    b = frames.select("frame_id", F.explode("boxes").alias("b"))
    xyz = lambda field, names: [F.col(f"b.{field}")[i].alias(n) for i, n in enumerate(names)]
    return b.select(
        "frame_id",
        "b.box_id",
        *xyz("center", ("center_x", "center_y", "center_z")),
        *xyz("extent", ("extent_x", "extent_y", "extent_z")),
        "b.yaw",
        *xyz("dimensions", ("length", "width", "height")),
        "b.volume",
        "b.num_points",
        F.coalesce("b.score", F.lit(1.0)).alias("score"),
        F.coalesce("b.semantic_id", F.lit(0)).alias("semantic_id"),
        F.coalesce("b.valid", F.lit(True)).alias("valid"),
        F.coalesce("b.cluster_id", F.lit(-1)).alias("cluster_id"),
    )


def write_jsonl(frames: DataFrame, path: str, append: bool = False) -> None:
    """Replaces ``path`` by JSON lines, or adds to it."""
    frames.write.mode("append" if append else "overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, line: str | None = None) -> DataFrame:
    """Frames of boxes; a malformed line fails the read, blank lines are skipped.

    ``line`` names a column with the place of each record: file, offset of the part that was read and
    order within it, so that later lines of a file compare greater.
    """
    rows = spark.read.schema(FRAME_BOXES).option("mode", "FAILFAST").json(path)
    if line is None:
        return rows
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"), F.monotonically_increasing_id().alias("row"))
    return rows.withColumn(line, place)


def write_parquet(flat: DataFrame, path: str) -> None:
    """Replaces ``path`` by flat boxes in the published column order; missing columns are null."""
    have = set(flat.columns)
    flat.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in FLAT_BOX]).write.mode("overwrite").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FLAT_BOX).parquet(path)


def one_record_per_frame(records: DataFrame, line: str = "line_no", last: bool = True) -> DataFrame:
    """Of repeated records of a frame the last (or first) by line number; negative frames are dropped."""
    order = F.desc(line) if last else F.asc(line)
    number = F.row_number().over(Window.partitionBy("frame_id").orderBy(order))
    return records.where("frame_id >= 0").withColumn("_n", number).where("_n = 1").drop("_n")


def available_frames(records: DataFrame) -> DataFrame:
    """The frames that have a record, sorted, repeats kept."""
    return records.select("frame_id").orderBy("frame_id")
