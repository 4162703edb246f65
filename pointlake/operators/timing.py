"""Timing records: capture, module and frame statistics, reports."""

from __future__ import annotations

import functools
import json
import platform
import time
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointlake.schema import TIMING
from pointlake.session import read_text


class Timings:
    """Collects timing records on the driver."""

    def __init__(self, enabled: bool = True):
        self.enabled, self.records = enabled, []

    def record(self, module: str, duration_ms: float, frame_id: int | None = None, input_points: int | None = None, output_points: int | None = None) -> None:
        if self.enabled:
            self.records.append((module, frame_id, float(duration_ms), input_points, output_points))

    @contextmanager
    def measure(self, module: str, frame_id: int | None = None):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.record(module, (time.perf_counter() - began) * 1000, frame_id)

    def timed(self, module: str):
        def wrap(f):
            @functools.wraps(f)
            def run(*args, **kwargs):
                with self.measure(module):
                    return f(*args, **kwargs)

            return run

        return wrap

    def reset(self) -> None:
        self.records.clear()

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.records, TIMING)


def _spread(c: str) -> list[Column]:
    return [F.avg(c).alias("mean_ms"), F.stddev_pop(c).alias("std_ms"), *[F.percentile(c, p / 100).alias(f"p{p}_ms") for p in (50, 90, 99)], F.min(c).alias("min_ms"), F.max(c).alias("max_ms"), F.sum(c).alias("total_ms")]


def module_stats(timing: DataFrame) -> DataFrame:
    """By module: count, mean, population deviation, percentiles, extremes, total, and its share of all time in percent."""
    stats = timing.groupBy("module").agg(F.count("*").alias("count"), *_spread("duration_ms"))
    share = 100 * F.col("total_ms") / F.sum("total_ms").over(Window.partitionBy())
    return stats.withColumn("percent", F.coalesce(share, F.lit(0.0)))


def frame_times(timing: DataFrame) -> DataFrame:
    """Milliseconds of each frame: its "total" records if there are any at all, else the sum of its modules."""
    has_total = F.max((F.col("module") == "total").cast("int")).over(Window.partitionBy("frame_id"))
    rows = timing.where("frame_id IS NOT NULL").withColumn("_t", has_total).where("_t = 0 OR module = 'total'")
    return rows.groupBy("frame_id").agg(F.sum("duration_ms").alias("duration_ms"))


def frame_stats(timing: DataFrame) -> DataFrame:
    """One row over frames: the spread of frame times and frames a second at the mean and percentiles."""
    stats = frame_times(timing).agg(F.count("*").alias("frames"), *_spread("duration_ms"))
    rate = lambda c: F.when(F.col(c) > 0, 1000 / F.col(c)).otherwise(F.lit(0.0))
    return stats.withColumns({"fps_mean": rate("mean_ms"), "fps_p50": rate("p50_ms"), "fps_p90": rate("p90_ms"), "fps_p99": rate("p99_ms")})


def throughput(timing: DataFrame) -> DataFrame:
    """By module with points: points in a second of its time; 0 without time."""
    sums = timing.where("input_points IS NOT NULL").groupBy("module").agg(F.sum("input_points").alias("points"), F.sum("duration_ms").alias("total_ms"))
    return sums.withColumn("points_per_s", F.when(F.col("total_ms") > 0, F.col("points") * 1000 / F.col("total_ms")).otherwise(F.lit(0.0)))


def slowest(timing: DataFrame, n: int = 10) -> DataFrame:
    """The n modules with the most time, most first."""
    return module_stats(timing).orderBy(F.desc("total_ms"), "module").limit(n)


def _short(row: dict) -> dict:
    """Milliseconds to 3 digits, rates and shares to 2."""
    return {k: round(v, 2 if k.startswith(("fps", "percent")) else 3) if isinstance(v, float) else v for k, v in row.items()}


def system_info() -> dict[str, str]:
    return {"os": platform.system(), "os_version": platform.version(), "python_version": platform.python_version(), "platform": platform.platform(), "processor": platform.processor() or "Unknown", "architecture": platform.machine()}


def summary(timing: DataFrame, total_points: int = 0) -> DataFrame:
    """One row: total_frames, total_time_ms over all records, total_points, points_per_second (0 without points or time).

    Frames are the "total" records if there are any, else the frames that have a record.
    """
    sums = timing.agg(F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("total_time_ms"), F.count_if(F.col("module") == "total").alias("_total"), F.countDistinct("frame_id").alias("_frames"))
    rate = F.when(F.col("total_time_ms") > 0, F.lit(total_points) * 1000 / F.col("total_time_ms")).otherwise(F.lit(0.0))
    return sums.select(F.when(F.col("_total") > 0, F.col("_total")).otherwise(F.col("_frames")).alias("total_frames"), "total_time_ms", F.lit(total_points).cast("long").alias("total_points"), rate.alias("points_per_second"))


def report(timing: DataFrame, total_points: int = 0, now: str | None = None) -> dict:
    """timestamp, system_info, modules (most time first), frame_timing (null without frames) and summary; small, so it is collected."""
    frames = frame_stats(timing).first().asDict()
    return {
        "timestamp": now or datetime.now().isoformat(),
        "system_info": system_info(),
        "modules": [_short(r.asDict()) for r in slowest(timing, 1000).collect()],
        "frame_timing": _short(frames) if frames["frames"] else None,
        "summary": _short(summary(timing, total_points).first().asDict()),
    }


def report_markdown(body: dict) -> str:
    """The report as text: summary, frames, modules."""
    whole, f = body["summary"], body["frame_timing"]
    lines = ["# Performance", "", f"Made {body['timestamp']} on {body['system_info']['platform']}.", ""]
    lines += [f"{whole['total_frames']} frames, {whole['total_time_ms']} ms in all modules, {whole['total_points']} points, {whole['points_per_second']} points a second.", ""]
    if f:
        lines += ["| frame time | ms |", "| --- | ---: |", *[f"| {k} | {f[f'{k}_ms']} |" for k in ("mean", "std", "p50", "p90", "p99", "min", "max")], "", f"Frames: {f['frames']}, {f['mean_ms']} ms a frame, {f['fps_mean']} frames a second.", ""]
    lines += ["| module | count | mean ms | std | p50 | p90 | p99 | min | max | total ms | % |", "| --- |" + " ---: |" * 10]
    lines += [f"| {m['module']} | " + " | ".join(str(m[k]) for k in ("count", "mean_ms", "std_ms", "p50_ms", "p90_ms", "p99_ms", "min_ms", "max_ms", "total_ms", "percent")) + " |" for m in body["modules"]]
    return "\n".join([*lines, ""])


def report_json(body: dict) -> str:
    return json.dumps(body, allow_nan=False, indent=2)


def load_report(spark: SparkSession, uri: str) -> dict:
    """A report that ``report_json`` wrote; parts that an older file lacks are empty."""
    got = json.loads(read_text(spark, uri))
    return {"timestamp": "", "system_info": {}, "modules": [], "frame_timing": None, "summary": {}} | got


def best_methods(results: DataFrame) -> DataFrame:
    """Of (ordinal, method, f1, mean_ms): the method with the best F1 and the fastest, the first on ties."""
    return results.agg(F.max_by("method", F.struct("f1", (-F.col("ordinal")).alias("o"))).alias("best_f1"), F.min_by("method", F.struct("mean_ms", "ordinal")).alias("fastest"))
