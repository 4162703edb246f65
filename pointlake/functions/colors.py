"""Colour ramps for points, in [0, 1]."""

from __future__ import annotations

import colorsys

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlake.functions.labels import COLORS
from pointlake.schema import frame_keys

GREY, GROUND, OBJECT = (0.5, 0.5, 0.5), (0.6, 0.4, 0.2), (0.2, 0.6, 1.0)


def _unit(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least((value.cast("double") - low) / (high - low), F.lit(1.0)), F.lit(0.0))


def by_height(z: Column, low: float = -2.0, high: float = 2.0) -> tuple[Column, Column, Column]:
    """Blue over cyan, green and yellow to red."""
    t = _unit(z, low, high)
    red = F.when(t < 0.5, F.lit(0.0)).otherwise(2 * (t - 0.5))
    green = F.when(t < 0.25, 4 * t).when(t < 0.75, F.lit(1.0)).otherwise(4 * (1 - t))
    blue = F.when(t < 0.5, 1 - 2 * t).otherwise(F.lit(0.0))
    return red, green, blue


# The quadratics of the distance ramp for red, green and blue.
RAMP = ((0.267, 0.329, 0.404), (0.004, 0.873, -0.377), (0.329, 0.089, -0.418))


def by_distance(x: Column, y: Column, low: float = 0.0, high: float = 50.0) -> tuple[Column, Column, Column]:
    t = _unit(F.sqrt(x.cast("double") * x.cast("double") + y.cast("double") * y.cast("double")), low, high)
    return tuple(F.greatest(F.least(F.lit(a) + F.lit(b) * t + F.lit(c) * t * t, F.lit(1.0)), F.lit(0.0)) for a, b, c in RAMP)


def by_label(semantic: Column) -> Column:
    """Red, green, blue of a label as an array; unknown ones are grey."""
    table = {i: [r / 255, g / 255, b / 255] for i, (b, g, r) in COLORS.items()}
    pairs = [F.lit(x) if isinstance(x, int) else F.array(*[F.lit(v) for v in x]) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), semantic.cast("int")), F.array(*[F.lit(v) for v in GREY]))


def by_ground(is_ground: Column) -> Column:
    return F.when(is_ground, F.array(*[F.lit(v) for v in GROUND])).otherwise(F.array(*[F.lit(v) for v in OBJECT]))


def palette(n: int, seed: int = 42) -> list[tuple[float, float, float]]:
    """n hues at even distances, dealt in a seeded order, at saturation 0.8 and value 0.9."""
    return [colorsys.hsv_to_rgb(float(h), 0.8, 0.9) for h in shuffled_hues(n, seed)]


def shuffled_hues(n: int, seed: int) -> np.ndarray:
    hues = np.linspace(0, 1, n, endpoint=False)
    np.random.default_rng(seed).shuffle(hues)
    return hues


def _from_palette(ordinal: Column, colours: list) -> Column:
    """The colour of a 0-based ordinal; null and negative ones are grey."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in colours]) if colours else F.array().cast("array<array<double>>")
    return F.coalesce(F.get(table, F.when(ordinal >= 0, ordinal.cast("int"))), F.array(*[F.lit(v) for v in GREY]))


def by_cluster(cluster_id: Column, n: int, seed: int = 42) -> Column:
    """Red, green, blue of dense cluster ids 0..n-1 as an array; noise (null or negative) is grey."""
    return _from_palette(cluster_id, palette(n, seed))


def by_instance(points: DataFrame, seed: int = 42, most: int = 65_536) -> DataFrame:
    """Adds ``color``: each positive instance_id has the colour of its place among the ids of its frame, others are grey.

    Ids have 16 bits, so a palette has at most ``most`` colours; it is as long as the frame with the most ids.
    """
    keys = frame_keys(points)
    ids = points.where("instance_id > 0").select(*keys, "instance_id").distinct()
    placed = ids.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("instance_id")) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    sizes = [r["_n"] for r in placed.select("_n").distinct().limit(most).collect()]  # one number a distinct count
    rows = [(n, i, list(map(float, c))) for n in sizes for i, c in enumerate(palette(n, seed))]
    table = points.sparkSession.createDataFrame(rows, "_n long, _at int, color array<double>")
    coloured = placed.join(table, ["_n", "_at"]).select(*keys, "instance_id", "color")
    return points.join(coloured, [*keys, "instance_id"], "left").withColumn("color", F.coalesce("color", F.array(*[F.lit(v) for v in GREY])))
