"""Streaming extensions: detection over arriving frames and windowed event metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_points(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """Point files (Parquet) as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def detect_stream(points: DataFrame, config: dict, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the boxes of each batch of whole frames to ``out``/batch=<n>; a batch that runs again replaces its own."""
    from pointlake.plans.detect import detect

    def write(batch: DataFrame, number: int) -> None:
        detect(batch, config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_events(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Count, sum and extremes of values by event type and time window; rows later than ``late`` are dropped."""
    values = [F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most")]
    out = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(*values)
    return out.select(F.col("w.start").alias("begins"), "event_type", "n", "total", "least", "most")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: begin, end and events, cut after ``gap`` without one."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("begins"), F.col("s.end").alias("ends"), "n")
