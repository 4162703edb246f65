"""Row types of the engine: points, boxes, frames of boxes and timing records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "doubles": T.ArrayType(T.DoubleType())}


def row_type(fields: str, **more: T.DataType) -> T.StructType:
    """A row type from "name type, ..." without a session; ``more`` names further types."""
    known = _TYPES | more
    return T.StructType([T.StructField(n, known[k]) for n, k in (f.split() for f in fields.split(", "))])


POINT = row_type("sequence string, frame_id int, point_id long, x float, y float, z float, remission float, semantic_id int, instance_id int")
BOX = row_type("box_id int, center doubles, extent doubles, yaw double, dimensions doubles, volume double, num_points int, score double, semantic_id int, valid boolean, cluster_id int")
FRAME_BOXES = row_type("frame_id int, num_boxes int, num_valid_boxes int, boxes boxes, timestamp string, processing_time_ms double", boxes=T.ArrayType(BOX))
FLAT_BOX = row_type(
    "frame_id int, timestamp string, processing_time_ms double, box_id int, center_x double, center_y double, center_z double, extent_x double, extent_y double, extent_z double, yaw double, "
    "length double, width double, height double, volume double, num_points int, score double, semantic_id int, valid boolean, cluster_id int"
)
TIMING = row_type("module string, frame_id long, duration_ms double, input_points long, output_points long")


def frame_keys(df: DataFrame) -> list[str]:
    """The columns that name a frame: sequence (if there) and frame_id."""
    return [c for c in ("sequence", "frame_id") if c in df.columns]


def require(df: DataFrame, *columns: str) -> None:
    """Fails when the plan is built if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
