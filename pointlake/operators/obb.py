"""Oriented boxes: fit to clusters, judge, and test points against them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlake.functions.numerics import half_turn
from pointlake.schema import frame_keys

LEAST_EXTENT = 1e-6
#: A covariance up to this part of the difference of the variances is an axis of the grid; the yaw moves by half of it at most.
ALIGNED = 1e-11


def fit_boxes(points: DataFrame, group: Sequence[str] = ("cluster_id",), z_percentile: float = 5.0) -> DataFrame:
    """One row a group: num_points, center_{x,y,z}, extent_{x,y,z} (half sizes), yaw.

    The yaw is the major axis of the XY covariance in closed form, half of
    atan2(2 sxy, sxx - syy), in (-pi/2, pi/2]; a group without a major axis has pi/2. Where the
    covariance is 0 but for rounding, which differs by the order of the rows, it counts as 0, so a
    group longer in y has pi/2 in every run. Sides come from the extremes along the axes, heights from
    percentiles. Groups of fewer than three points have nulls. Two aggregates on the same keys: moments,
    then extremes of the turned coordinates, which carry the moments that turned them.
    """
    keys = [*frame_keys(points), *group]
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    p = z_percentile / 100
    moments = points.groupBy(*keys).agg(
        F.count("*").alias("num_points"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.var_samp(x).alias("_sxx"), F.var_samp(y).alias("_syy"), F.covar_samp(x, y).alias("_sxy"), F.percentile(z, [p, 1 - p]).alias("_z")
    )
    flat = (F.abs(F.col("_sxx") - F.col("_syy")) <= 1e-12) & (F.abs(F.col("_sxy")) <= 1e-12)
    spread = F.col("_sxx") - F.col("_syy")
    sxy = F.when(F.abs(F.col("_sxy")) <= ALIGNED * F.abs(spread), F.lit(0.0)).otherwise(F.col("_sxy"))
    axis = F.when(flat, F.pi() / 2).otherwise(half_turn(F.atan2(2 * sxy, spread) / 2))
    moments = moments.where("num_points >= 3").withColumn("yaw", axis)
    dx, dy = x - F.col("_mx"), y - F.col("_my")
    along = dx * F.cos("yaw") + dy * F.sin("yaw")
    across = dy * F.cos("yaw") - dx * F.sin("yaw")
    own = [F.any_value(c).alias(c) for c in ("_mx", "_my", "_z", "yaw")]
    # moments computed a second time could be rounded, and so turned, another way
    sides = points.join(moments.select(*keys, "_mx", "_my", "_z", "yaw"), keys).groupBy(*keys).agg(F.min(along).alias("_a0"), F.max(along).alias("_a1"), F.min(across).alias("_b0"), F.max(across).alias("_b1"), *own)
    a, b = (F.col("_a0") + F.col("_a1")) / 2, (F.col("_b0") + F.col("_b1")) / 2
    low, high = F.col("_z")[0], F.col("_z")[1]
    extent = lambda c: F.greatest(c / 2, F.lit(LEAST_EXTENT))
    fitted = sides.select(
        *keys,
        (F.col("_mx") + a * F.cos("yaw") - b * F.sin("yaw")).alias("center_x"),
        (F.col("_my") + a * F.sin("yaw") + b * F.cos("yaw")).alias("center_y"),
        ((low + high) / 2).alias("center_z"),
        extent(F.col("_a1") - F.col("_a0")).alias("extent_x"),
        extent(F.col("_b1") - F.col("_b0")).alias("extent_y"),
        extent(high - low).alias("extent_z"),
        "yaw",
    )
    return points.groupBy(*keys).agg(F.count("*").alias("num_points")).join(fitted, keys, "left")


@dataclass(frozen=True)
class BoxLimits:
    min_points: int = 3
    min_volume: float = 0.1
    max_volume: float = 1000.0


def judge_boxes(boxes: DataFrame, limits: BoxLimits = BoxLimits()) -> DataFrame:
    """Adds length, width, height, volume, valid and reason (null if valid). Boxes at a volume limit are valid."""
    volume = 8 * F.col("extent_x") * F.col("extent_y") * F.col("extent_z")
    out = boxes.withColumns({"length": 2 * F.col("extent_x"), "width": 2 * F.col("extent_y"), "height": 2 * F.col("extent_z"), "volume": volume})
    told = lambda name: F.concat(F.lit(f"{name} ("), F.format_string("%.3f", "volume"), F.lit(")"))
    reason = (
        F.when(F.col("num_points") < limits.min_points, F.lit("insufficient_points"))
        .when(F.col("volume").isNull(), F.lit("fit_failed"))
        .when(F.col("volume") < limits.min_volume, told("volume_too_small"))
        .when(F.col("volume") > limits.max_volume, told("volume_too_large"))
    )
    return out.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def numbered_boxes(boxes: DataFrame, order: str = "cluster_id") -> DataFrame:
    """Adds box_id, the 0-based ordinal in each frame; a box that has no shape gets zeros and stays invalid."""
    number = F.row_number().over(Window.partitionBy(*frame_keys(boxes)).orderBy(order)) - 1
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("center_x", "center_y", "center_z", "extent_x", "extent_y", "extent_z", "yaw", "length", "width", "height", "volume")}
    return boxes.withColumn("box_id", number.cast("int")).withColumns(zero)


def corners(center_x: Column, center_y: Column, half_x: Column, half_y: Column, yaw: Column) -> Column:
    """The four XY corners, counter-clockwise, as an array of (x, y)."""
    signs = ((-1, -1), (1, -1), (1, 1), (-1, 1))
    return F.array(*[F.struct((center_x + a * half_x * F.cos(yaw) - b * half_y * F.sin(yaw)).alias("x"), (center_y + a * half_x * F.sin(yaw) + b * half_y * F.cos(yaw)).alias("y")) for a, b in signs])


def corners_3d(boxes: DataFrame) -> DataFrame:
    """Adds ``corners``: four at the bottom, then four at the top, counter-clockwise."""
    flat = corners(*(F.col(c) for c in ("center_x", "center_y", "extent_x", "extent_y", "yaw")))
    at = lambda sign: F.transform(flat, lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), (F.col("center_z") + sign * F.col("extent_z")).alias("z")))
    return boxes.withColumn("corners", F.concat(at(-1), at(1)))


def inside(x: Column, y: Column, z: Column) -> Column:
    """Whether a point is in the box of the row, faces included."""
    dx, dy = x - F.col("center_x"), y - F.col("center_y")
    along, across = dx * F.cos("yaw") + dy * F.sin("yaw"), dy * F.cos("yaw") - dx * F.sin("yaw")
    return (F.abs(along) <= F.col("extent_x")) & (F.abs(across) <= F.col("extent_y")) & (F.abs(z - F.col("center_z")) <= F.col("extent_z"))


def _cell_span(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float = 4.0) -> DataFrame:
    """frame, point_id, box_id of the first box (least box_id) that holds each point; points in none are left out.

    ``boxes``: valid or not; invalid ones keep their place in the order and hold nothing. A box meets
    only the points of the grid cells that its XY bounds touch, in an equi-join, so no frame is
    crossed with all its boxes.
    """
    keys = frame_keys(points)
    reach_x = F.abs(F.col("extent_x") * F.cos("yaw")) + F.abs(F.col("extent_y") * F.sin("yaw"))
    reach_y = F.abs(F.col("extent_x") * F.sin("yaw")) + F.abs(F.col("extent_y") * F.cos("yaw"))
    shape = ["center_x", "center_y", "center_z", "extent_x", "extent_y", "extent_z", "yaw"]
    cells = boxes.where("valid").select(*keys, "box_id", *shape, F.explode(_cell_span(F.col("center_x") - reach_x, F.col("center_x") + reach_x, cell)).alias("_cx"), reach_y.alias("_ry"))
    cells = cells.select(*keys, "box_id", *shape, "_cx", F.explode(_cell_span(F.col("center_y") - F.col("_ry"), F.col("center_y") + F.col("_ry"), cell)).alias("_cy"))
    x, y, z = (F.col(c).cast("double") for c in "xyz")
    placed = points.select(*keys, "point_id", x.alias("x"), y.alias("y"), z.alias("z"), F.floor(x / cell).alias("_cx"), F.floor(y / cell).alias("_cy"))
    met = placed.join(cells, [*keys, "_cx", "_cy"]).where(inside(F.col("x"), F.col("y"), F.col("z")))
    return met.groupBy(*keys, "point_id").agg(F.min("box_id").alias("box_id"))
