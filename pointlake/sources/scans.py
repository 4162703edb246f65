"""Scan directories: binary points and labels, poses, calibration, and metadata-only listings.

Layout: <root>/sequences/<NN>/velodyne/NNNNNN.bin (float32 x, y, z, remission) and labels/NNNNNN.label
(uint32 a point). Files are read through the engine's binary source, so any file system it knows
works, and frames are pruned by file name before content is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.functions.labels import instance_of, label_of_training, packed, semantic_of
from pointlake.session import exists

_NAME = r"sequences/(\d+)/[^/]+/(\d+)\.\w+$"


def sequence_name(sequence: str | int) -> str:
    return str(sequence).zfill(2)


def _files(spark: SparkSession, root: str, sequence: str | int, kind: str, suffix: str) -> DataFrame:
    path = f"{root}/sequences/{sequence_name(sequence)}/{kind}"
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(path)


def _frame_id(path: Column) -> Column:
    return F.regexp_extract(path, _NAME, 2).cast("int")


def scan_info(spark: SparkSession, root: str, sequence: str | int) -> DataFrame:
    """sequence, frame_id, scan_bytes, points, label_bytes, labels of each frame, from file sizes alone."""
    scans = _files(spark, root, sequence, "velodyne", "bin").select(_frame_id(F.col("path")).alias("frame_id"), F.col("length").alias("scan_bytes"))
    out = scans.withColumn("points", F.expr("scan_bytes div 16"))
    try:
        labels = _files(spark, root, sequence, "labels", "label").select(_frame_id(F.col("path")).alias("frame_id"), F.col("length").alias("label_bytes"))
        out = out.join(labels, "frame_id", "left")
    except Exception as e:  # a sequence without labels has no such folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
        out = out.withColumn("label_bytes", F.lit(None).cast("long"))
    return out.withColumn("labels", F.expr("label_bytes div 4")).withColumn("sequence", F.lit(sequence_name(sequence)))


def open_sequence(spark: SparkSession, root: str, sequence: str | int) -> DataFrame:
    """``scan_info`` of a sequence that has its folder and at least one scan; else FileNotFoundError."""
    name = sequence_name(sequence)
    for part in (root, f"{root}/sequences/{name}", f"{root}/sequences/{name}/velodyne"):
        if not exists(spark, part):
            raise FileNotFoundError(part)
    info = scan_info(spark, root, name)
    if info.isEmpty():
        raise FileNotFoundError(f"no scans in {root}/sequences/{name}/velodyne")
    return info


def read_frame(spark: SparkSession, root: str, sequence: str | int, frame_id: int) -> DataFrame:
    """The points of one frame, whose file alone is read; IndexError if the sequence has no such frame."""
    info = open_sequence(spark, root, sequence)
    if frame_id < 0 or info.where(F.col("frame_id") == frame_id).isEmpty():
        raise IndexError(f"frame {frame_id} is not in sequence {sequence_name(sequence)}")
    return read_scans(spark, root, sequence, frame_id, frame_id + 1)


def prediction_files(spark: SparkSession, root: str, sequence: str | int) -> DataFrame:
    """frame_id, path, points of each prediction file, from names and sizes alone; a missing folder has none."""
    path = f"{root}/sequences/{sequence_name(sequence)}/predictions"
    if not exists(spark, path):
        return spark.createDataFrame([], "frame_id int, path string, points long")
    files = _files(spark, root, sequence, "predictions", "label")
    return files.select(_frame_id(F.col("path")).alias("frame_id"), "path", F.expr("length div 4").alias("points"))


def sequences_with_predictions(spark: SparkSession, root: str) -> list[str]:
    """The sequence folders below ``root``, a directory listing of at most a few dozen names."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/sequences")
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in store.listStatus(top) if s.isDirectory()) if store.exists(top) else []


_POINT = "frame_id int, point_id long, x float, y float, z float, remission float"


def _decode_scans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for frame, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = content.as_buffer()
            if raw.size % 16:
                raise ValueError(f"frame {frame}: {raw.size} bytes is no whole number of points")
            values = np.frombuffer(raw, "<f4").reshape(-1, 4)
            for lo in range(0, len(values), 100_000):
                part = values[lo : lo + 100_000]
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, frame, np.int32)), pa.array(np.arange(lo, lo + n)), *[pa.array(np.ascontiguousarray(part[:, k])) for k in range(4)]], ["frame_id", "point_id", "x", "y", "z", "remission"])


def _decode_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for frame, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = content.as_buffer()
            if raw.size % 4:
                raise ValueError(f"frame {frame}: {raw.size} bytes is no whole number of labels")
            values = np.frombuffer(raw, "<u4").astype(np.int64)
            n = len(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, frame, np.int32)), pa.array(np.arange(n)), pa.array(values)], ["frame_id", "point_id", "raw_label"])


def read_scans(spark: SparkSession, root: str, sequence: str | int, start: int = 0, end: int | None = None) -> DataFrame:
    """sequence, frame_id, point_id, x, y, z, remission of all points; frames outside the range are never read."""
    files = _files(spark, root, sequence, "velodyne", "bin").withColumn("frame_id", _frame_id(F.col("path")))
    files = files.where(F.col("frame_id") >= start) if end is None else files.where(F.col("frame_id").between(start, end - 1))
    return files.select("frame_id", "content").mapInArrow(_decode_scans, _POINT).withColumn("sequence", F.lit(sequence_name(sequence)))


def read_raw_labels(spark: SparkSession, root: str, sequence: str | int, kind: str = "labels") -> DataFrame:
    """sequence, frame_id, point_id, raw_label; ``kind`` may be predictions."""
    files = _files(spark, root, sequence, kind, "label").select(_frame_id(F.col("path")).alias("frame_id"), "content")
    return files.mapInArrow(_decode_labels, "frame_id int, point_id long, raw_label long").withColumn("sequence", F.lit(sequence_name(sequence)))


def unpacked(labels: DataFrame) -> DataFrame:
    return labels.select("sequence", "frame_id", "point_id", semantic_of(F.col("raw_label")).alias("semantic_id"), instance_of(F.col("raw_label")).alias("instance_id"))


def read_labelled(spark: SparkSession, root: str, sequence: str | int) -> DataFrame:
    """Points with semantic_id and instance_id. Fails if a frame has not one label a point; frames without labels have nulls."""
    info = scan_info(spark, root, sequence)
    wrong = info.where("labels IS NOT NULL AND (labels <> points OR scan_bytes % 16 <> 0)").limit(1).collect()
    if wrong:
        raise ValueError(f"frame {wrong[0]['frame_id']}: {wrong[0]['points']} points and {wrong[0]['labels']} labels")
    return read_scans(spark, root, sequence).join(unpacked(read_raw_labels(spark, root, sequence)), ["sequence", "frame_id", "point_id"], "left")


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """frame_id, pose (12 numbers by rows): the lines with twelve numbers, in order."""
    # one small text file; its lines are numbered in the order of the file
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text"))
    poses = lines.select("line", F.transform(F.split(F.trim("text"), r"\s+"), lambda v: v.try_cast("double")).alias("pose")).where(F.size("pose") == 12)
    number = F.expr("row_number() OVER (ORDER BY line) - 1").cast("int")
    return poses.select(number.alias("frame_id"), "pose")


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """key, matrix (12 numbers by rows) of P* and Tr."""
    lines = spark.read.text(path).select(F.split("value", ":", 2).alias("kv")).where(F.size("kv") == 2)
    rows = lines.select(F.trim(F.col("kv")[0]).alias("key"), F.transform(F.split(F.trim(F.col("kv")[1]), r"\s+"), lambda v: v.try_cast("double")).alias("matrix"))
    return rows.where((F.col("key").startswith("P") | (F.col("key") == "Tr")) & (F.size("matrix") == 12))


def prediction_path(root: str, sequence: str | int, frame_id: int) -> str:
    return f"{root}/sequences/{sequence_name(sequence)}/predictions/{frame_id:06d}.label"


def write_labels(labels: DataFrame, root: str, inverse_training: bool = False) -> DataFrame:
    """Writes one .label file a frame from sequence, frame_id, point_id, semantic_id, instance_id; returns frame_id, points, error.

    Frames are independent: a frame that fails has its error in the result and the others are
    written. ``root`` is a URI; file names are fixed, so a task that runs again writes the same.
    """
    semantic = label_of_training(F.col("semantic_id")) if inverse_training else F.col("semantic_id")
    rows = labels.select("sequence", "frame_id", "point_id", packed(F.coalesce(semantic, F.lit(0)), F.coalesce("instance_id", F.lit(0))).alias("raw"))

    def write(table: pa.Table) -> pa.Table:
        from pyarrow import fs

        sequence, frame = table.column("sequence")[0].as_py(), table.column("frame_id")[0].as_py()
        error = None
        try:
            order = np.argsort(table.column("point_id").to_numpy(), kind="stable")
            values = table.column("raw").to_numpy()[order].astype("<u4")
            store, path = fs.FileSystem.from_uri(prediction_path(root, sequence, frame))
            store.create_dir(path.rpartition("/")[0], recursive=True)
            with store.open_output_stream(path) as out:
                out.write(values.tobytes())
        except Exception as e:  # reported by frame
            error = str(e)
        return pa.table({"sequence": [sequence], "frame_id": pa.array([frame], pa.int32()), "points": [table.num_rows], "error": pa.array([error], pa.string())})

    return rows.groupBy("sequence", "frame_id").applyInArrow(lambda t: write(t), "sequence string, frame_id int, points long, error string")


def export_failures(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """frame_id, error of the frames (frame_id) that were to be written and were not."""
    both = wanted.select("frame_id").join(done.select("frame_id", "error", F.lit(True).alias("_there")), "frame_id", "left")
    return both.where("_there IS NULL OR error IS NOT NULL").select("frame_id", F.coalesce("error", F.lit("no labels")).alias("error"))


def export_totals(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """One row: frames, exported, failed, points."""
    both = wanted.select("frame_id").join(done.select("frame_id", "error", "points"), "frame_id", "left")
    good = F.col("points").isNotNull() & F.col("error").isNull()
    sums = both.agg(F.count("*").alias("frames"), F.count_if(good).alias("exported"), F.coalesce(F.sum(F.when(good, F.col("points"))), F.lit(0)).alias("points"))
    return sums.select("frames", "exported", (F.col("frames") - F.col("exported")).alias("failed"), "points")
