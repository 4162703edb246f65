"""What a picture shows, as rows: points with colours, boxes in the display region, their outcome and their edges.

Drawing itself (an interactive viewer, video) is left to whoever reads these rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions import colors
from pointlake.operators import clusters, grid, ground, matching, roi, voxel
from pointlake.plans import detect
from pointlake.schema import frame_keys

#: Corner numbers of the twelve edges of a box: bottom, top, uprights.
EDGES = tuple((a, (a + 1) % 4) for a in range(4)) + tuple((4 + a, 4 + (a + 1) % 4) for a in range(4)) + tuple((a, a + 4) for a in range(4))


def display_bounds(config: dict) -> roi.Roi:
    """The region shown: ``visualization.display_roi`` over ``preprocess.roi`` in x and y, heights of the latter."""
    base = roi.Roi.from_config(config, defaults=True)
    own = config.get("visualization", {}).get("display_roi") or {}
    flat = {k: float(own.get(k, getattr(base, k))) for k in ("x_min", "x_max", "y_min", "y_max")}
    return roi.Roi(**flat, z_min=base.z_min, z_max=base.z_max)


def in_display(boxes: DataFrame, bounds: roi.Roi) -> DataFrame:
    """Boxes whose centre is in the region's x and y, edges included."""
    return boxes.where(F.col("center_x").between(bounds.x_min, bounds.x_max) & F.col("center_y").between(bounds.y_min, bounds.y_max))


def stage_points(points: DataFrame, config: dict) -> DataFrame:
    """The points that a frame's pictures show: x, y, z, is_ground and the cluster before filtering (-1 for ground and noise), with a height colour."""
    cropped = roi.crop(points, roi.Roi.from_config(config, defaults=True))
    segmented = ground.segment_ground(detect.numbered(voxel.downsample(cropped, config), cropped), detect.ground_rules(config)).drop("reason")
    found = clusters.dense_ids(grid.propose(segmented.where("NOT is_ground").drop("is_ground"), config))
    keys = [*frame_keys(points), "point_id"]
    labelled = segmented.join(found.select(*keys, "cluster_id"), keys, "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))
    return labelled.withColumn("color", F.array(*colors.by_height(F.col("z"))))


def overlay(points: DataFrame, boxes: DataFrame, config: dict) -> DataFrame:
    """Boxes of the display region with ``side`` (prediction, reference) and ``matched``, by the rules of the evaluation.

    Only boxes that are shown take part in the matching.
    """
    bounds = display_bounds(config)
    preds, refs = (in_display(side, bounds) for side in detect.both_sides(points, boxes, config))
    keys = frame_keys(preds)
    hits = matching.match_boxes(matching.overlaps(preds, refs), float(config.get("evaluation", {}).get("iou_threshold", 0.5)))
    shape = ["box_id", "semantic_id", *matching.SHAPE]

    def marked(side: DataFrame, name: str, own: str) -> DataFrame:
        hit = hits.select(*keys, F.col(own).cast("long").alias("box_id"), F.lit(True).alias("_hit"))
        rows = side.select(*keys, *shape).withColumn("box_id", F.col("box_id").cast("long"))
        return rows.join(hit, [*keys, "box_id"], "left").select(*keys, F.lit(name).alias("side"), *shape, F.coalesce("_hit", F.lit(False)).alias("matched"))

    return marked(preds, "prediction", "p_id").union(marked(refs, "reference", "r_id"))


def overlay_counts(shown: DataFrame) -> DataFrame:
    """By frame: tp, fp, fn of an overlay."""
    prediction = F.col("side") == "prediction"
    return shown.groupBy(*frame_keys(shown)).agg(F.count_if(prediction & F.col("matched")).alias("tp"), F.count_if(prediction & ~F.col("matched")).alias("fp"), F.count_if(~prediction & ~F.col("matched")).alias("fn"))


def box_edges(boxes: DataFrame) -> DataFrame:
    """frame, box_id, edge, ax, ay, az, bx, by, bz of the twelve edges of each box."""
    keys = frame_keys(boxes)
    at = lambda values, corner: F.get(F.array(*[F.lit(v) for v in values]), corner)
    rows = boxes.withColumn("edge", F.explode(F.array(*[F.lit(i) for i in range(len(EDGES))])))

    def end(name: str, side: int) -> list[Column]:
        corner = at([e[side] for e in EDGES], F.col("edge"))
        along, across = at((-0.5, 0.5, 0.5, -0.5), corner % 4) * F.col("length"), at((-0.5, -0.5, 0.5, 0.5), corner % 4) * F.col("width")
        x = F.col("center_x") + along * F.cos("yaw") - across * F.sin("yaw")
        y = F.col("center_y") + along * F.sin("yaw") + across * F.cos("yaw")
        z = F.col("center_z") + F.when(corner < 4, -0.5).otherwise(0.5) * F.col("height")
        return [x.alias(f"{name}x"), y.alias(f"{name}y"), z.alias(f"{name}z")]

    return rows.select(*keys, "box_id", "edge", *end("a", 0), *end("b", 1))


def frame_list(results: DataFrame, max_frames: int | None = None, stride: int = 1) -> DataFrame:
    """The frames of a video in order: every ``stride``-th, at most ``max_frames``, which is that option's purpose."""
    frames = results.select(*frame_keys(results)).distinct().where(F.col("frame_id") % stride == 0).orderBy(*frame_keys(results))
    return frames if max_frames is None else frames.limit(max_frames)
