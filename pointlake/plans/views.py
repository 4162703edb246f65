"""Deterministic point views over the benchmark tables, as the same expressions for Spark and SQL engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ID = "row_number() OVER (PARTITION BY {frame} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)"
_PTS_FRAME, _OBJ_FRAME = "cast(floor(l_orderkey / 250e0) AS int)", "cast(floor(l_orderkey / 1000e0) AS int)"
_S = "(l_suppkey % 100)"

#: About 1,000 scattered points a frame.
PTS = {
    "frame_id": _PTS_FRAME,
    "point_id": f"cast({_PTS_FRAME} AS bigint) * 100000 + {_ID.format(frame=_PTS_FRAME)}",
    "x": "cast(l_extendedprice / 1500e0 AS float)",
    "y": "cast((l_partkey % 801) / 10e0 - 40e0 AS float)",
    "z": "cast(l_tax * 75e0 - 3e0 + l_discount AS float)",
}
#: About 100 compact objects a frame.
OBJ = {
    "frame_id": _OBJ_FRAME,
    "point_id": f"cast({_OBJ_FRAME} AS bigint) * 100000 + {_ID.format(frame=_OBJ_FRAME)}",
    "x": f"cast(({_S} % 10) * 7 + l_discount * 10e0 AS float)",
    "y": f"cast(floor({_S} / 10e0) * 8 - 40 + l_tax * 12.5e0 AS float)",
    "z": "cast(l_quantity / 25e0 - 1e0 AS float)",
    "instance_id": f"cast({_S} + 1 AS int)",
    "cluster_id": f"cast({_S} AS int)",
    "semantic_id": f"cast(CASE {_S} % 8 WHEN 0 THEN 10 WHEN 1 THEN 30 WHEN 2 THEN 252 WHEN 3 THEN 254 WHEN 4 THEN 256 WHEN 5 THEN 50 WHEN 6 THEN 31 ELSE 77 END AS int)",
}
#: Objects with ground: first lines become ground points.
SCENE = {
    "frame_id": _OBJ_FRAME,
    "point_id": OBJ["point_id"],
    "x": f"CASE WHEN l_linenumber = 1 THEN {PTS['x']} ELSE {OBJ['x']} END",
    "y": f"CASE WHEN l_linenumber = 1 THEN {PTS['y']} ELSE {OBJ['y']} END",
    "z": f"CASE WHEN l_linenumber = 1 THEN cast(l_tax - 1.7e0 AS float) ELSE {OBJ['z']} END",
}
TIMING = {"module": "event_type", "frame_id": "user_id", "duration_ms": "value", "input_points": "event_id % 1000"}


def sql(view: dict[str, str], table: str = "lineitem") -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in view.items())} FROM {table}"


def _read(spark: SparkSession, sf_dir: str, view: dict[str, str], table: str = "lineitem") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{e} AS {n}" for n, e in view.items()])


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, PTS)


def obj(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, OBJ)


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, SCENE)


def timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, TIMING, "events")
