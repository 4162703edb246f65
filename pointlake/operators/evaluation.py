"""Detection evaluation: reference boxes from labels, frame rows, and metrics overall and by distance."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.functions.labels import THINGS
from pointlake.functions.numerics import strict_bin
from pointlake.operators.obb import fit_boxes
from pointlake.schema import frame_keys

DISTANCE_EDGES = (0.0, 10.0, 20.0, 30.0, 40.0, 50.0, float("inf"))


def distance_edges(edges: Sequence[float]) -> list[float]:
    """Increasing edges with an infinite one at the end."""
    out = [float(e) for e in edges]
    if len(out) < 2 or any(b <= a for a, b in zip(out, out[1:], strict=False)):
        raise ValueError("distance bins must be strictly increasing with at least two edges")
    return out if out[-1] == float("inf") else [*out, float("inf")]


def bin_name(low: float, high: float) -> str:
    return f"{low:.0f}m+" if high == float("inf") else f"{low:.0f}-{high:.0f}m"


def reference_boxes(points: DataFrame, min_points: int = 10, z_percentile: float = 5.0) -> DataFrame:
    """A box for each labelled instance: frame, instance_id, semantic_id, num_points, center, size, yaw.

    Instances are grouped by id alone (above 0); the class is the most frequent one, the least id on
    ties, and must be countable.
    """
    keys = frame_keys(points)
    own = points.where("instance_id > 0")
    votes = own.groupBy(*keys, "instance_id", "semantic_id").agg(F.count("*").alias("_n"))
    classes = votes.groupBy(*keys, "instance_id").agg(F.sum("_n").alias("_all"), F.max_by("semantic_id", F.struct("_n", (-F.col("semantic_id")).alias("least"))).alias("semantic_id"))
    good = classes.where((F.col("_all") >= min_points) & F.col("semantic_id").isin(*THINGS)).select(*keys, "instance_id", "semantic_id")
    boxes = fit_boxes(own.join(good, [*keys, "instance_id"], "left_semi"), ["instance_id"], z_percentile).where("center_x IS NOT NULL")
    sized = boxes.withColumns({"length": 2 * F.col("extent_x"), "width": 2 * F.col("extent_y"), "height": 2 * F.col("extent_z")})
    return sized.join(good, [*keys, "instance_id"])


def outcomes(predictions: DataFrame, references: DataFrame, matches: DataFrame, p_id: str = "box_id", r_id: str = "box_id") -> DataFrame:
    """frame, kind (tp, fp, fn), distance, iou: matched pairs and missed references at the reference's distance, false alarms at the prediction's.

    Predictions, references and matches are read once each.
    """
    keys = frame_keys(predictions)
    away = F.sqrt(F.col("center_x") ** 2 + F.col("center_y") ** 2).alias("distance")
    p = predictions.select(*keys, F.col(p_id).alias("id"), away, F.lit(False).alias("_ref"))
    r = references.select(*keys, F.col(r_id).alias("id"), away, F.lit(True).alias("_ref"))
    hit = F.explode(F.array(F.struct(F.col("p_id").cast("long").alias("id"), F.lit(False).alias("_ref")), F.struct(F.col("r_id").cast("long").alias("id"), F.lit(True).alias("_ref")))).alias("h")
    hits = matches.select(*keys, "iou", hit).select(*keys, "h.id", "h._ref", F.col("iou").cast("double").alias("iou"))
    both = p.union(r).withColumn("id", F.col("id").cast("long")).join(hits, [*keys, "id", "_ref"], "left")
    kind = F.when(F.col("iou").isNull(), F.when(F.col("_ref"), F.lit("fn")).otherwise(F.lit("fp"))).when(F.col("_ref"), F.lit("tp"))
    return both.select(*keys, kind.alias("kind"), "distance", "iou").where("kind IS NOT NULL")


def _ratios(counts: DataFrame) -> DataFrame:
    of = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    p, r = of(F.col("tp"), F.col("tp") + F.col("fp")), of(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", of(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _counts() -> list[Column]:
    kind = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return [kind("tp"), kind("fp"), kind("fn"), F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou")]


def metrics(results: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, mean_iou, precision, recall, f1; ratios over nothing are 0."""
    return _ratios(results.agg(*_counts()))


def metrics_by_distance(results: DataFrame, edges: Sequence[float] = DISTANCE_EDGES) -> DataFrame:
    """A row for each distance bin, empty ones too: bin, name and the metrics. Distances below the first edge are in none."""
    edges = distance_edges(edges)
    spark = results.sparkSession
    bins = spark.createDataFrame([(i, bin_name(a, b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, name string")
    counts = results.withColumn("bin", strict_bin(F.col("distance"), edges)).where("bin IS NOT NULL").groupBy("bin").agg(*_counts())
    full = bins.join(counts, "bin", "left").fillna(0, ["tp", "fp", "fn"]).fillna(0.0, ["mean_iou"])
    return _ratios(full)


def frame_rows(results: DataFrame) -> DataFrame:
    """By frame: tp, fp, fn and mean IoU."""
    return results.groupBy(*frame_keys(results)).agg(*_counts())


def iou_histogram(results: DataFrame) -> DataFrame:
    """bin, n: matched IoUs in [0, .25), [.25, .5), [.5, .75), [.75, 1]; above 1 counts nowhere."""
    iou = F.col("iou")
    at = F.when(iou.between(0.75, 1.0), 3).when((iou >= 0.5) & (iou < 0.75), 2).when((iou >= 0.25) & (iou < 0.5), 1).when((iou >= 0) & (iou < 0.25), 0)
    bins = results.sparkSession.createDataFrame([(i,) for i in range(4)], "bin int")
    counts = results.where("kind = 'tp'").groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").fillna(0, ["n"])


def confusion(pairs: DataFrame) -> DataFrame:
    """true_id, pred_id, n of a table with both columns."""
    return pairs.groupBy("true_id", "pred_id").agg(F.count("*").alias("n"))


def semantic_iou(pairs: DataFrame, ignore: Sequence[int] = (0,)) -> DataFrame:
    """class, tp, fp, fn, iou of each class that occurs on either side, but for ignored ones."""
    table = confusion(pairs)
    both = table.select(F.explode(F.array(F.struct(F.col("true_id").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("pred_id").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s"), "true_id", "pred_id", "n")
    hit = (F.col("true_id") == F.col("pred_id")).cast("long")
    sums = both.groupBy("s.class").agg(F.sum(F.col("n") * F.col("s.t") * hit).alias("tp"), F.sum(F.col("n") * F.col("s.p") * (1 - hit)).alias("fp"), F.sum(F.col("n") * F.col("s.t") * (1 - hit)).alias("fn"))
    kept = sums.where(~F.col("class").isin(*ignore)) if ignore else sums
    return kept.withColumn("iou", F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp") + F.col("fn")).cast("double")), F.lit(0.0)))


def semantic_summary(pairs: DataFrame, by: Sequence[str] = (), ignore: Sequence[int] = (0,)) -> DataFrame:
    """Mean IoU over the classes that occur and accuracy of (true_id, pred_id) pairs, for each group of the columns ``by``: classes, mean_iou, accuracy.

    Pairs whose true class is ignored do not count; a pair that is predicted as an ignored class is a miss of its true class.
    """
    kept = pairs.where(~F.col("true_id").isin(*ignore)) if ignore else pairs
    counts = kept.groupBy(*by, "true_id", "pred_id").agg(F.count("*").alias("n"))
    same = F.col("true_id") == F.col("pred_id")
    side = F.explode(F.array(F.struct(F.col("true_id").alias("class"), F.lit(True).alias("t")), F.struct(F.col("pred_id").alias("class"), F.lit(False).alias("t")))).alias("s")
    each = counts.withColumn("same", same).select(*by, "n", "same", side).groupBy(*by, "s.class").agg(F.sum(F.when(F.col("same") & F.col("s.t"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~F.col("same"), F.col("n")).otherwise(0)).alias("wrong"))
    each = each.where(~F.col("class").isin(*ignore)) if ignore else each
    iou = each.groupBy(*by).agg(F.count("*").alias("classes"), F.avg(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("wrong")).cast("double"))).alias("mean_iou"))
    right = counts.groupBy(*by).agg((F.sum(F.when(same, F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return iou.join(right, list(by)) if by else iou.crossJoin(right)  # one row each


def with_distance_bin(points: DataFrame, edges: Sequence[float] = (0.0, 10.0, 20.0, 30.0, 40.0, 50.0)) -> DataFrame:
    """Adds ``bin``, the name of the distance bin of x and y; points beyond the last edge or below the first go."""
    edges = [float(e) for e in edges]
    names = F.array(*[F.lit(bin_name(a, b)) for a, b in zip(edges, edges[1:], strict=False)])
    away = F.sqrt(F.col("x").cast("double") ** 2 + F.col("y").cast("double") ** 2)
    return points.withColumn("bin", F.get(names, strict_bin(away, edges))).where("bin IS NOT NULL")


def class_subset_mean(per_class: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean IoU over the named classes found (name, iou), and how many were missing."""
    key = F.translate(F.lower(F.trim("name")), " -", "__")
    found = per_class.where(key.isin(*names))
    return found.agg(F.avg("iou").alias("mean_iou"), (F.lit(len(set(names))) - F.count("*")).alias("missing"))


def metrics_json(overall: DataFrame, by_distance: DataFrame, config: dict, num_frames: int) -> str:
    """The metrics as strict JSON, with the counts of predictions and references. An infinite bin edge is written as "inf"."""
    plain = lambda v: "inf" if v == float("inf") else [plain(x) for x in v] if isinstance(v, (list, tuple)) else v
    whole = lambda r: (d := r.asDict()) | {"predictions": d["tp"] + d["fp"], "reference_boxes": d["tp"] + d["fn"]}
    body = {"overall": whole(overall.first()), "by_distance": {r["name"]: whole(r) for r in by_distance.collect()}, "config": {k: plain(v) for k, v in config.items()}, "num_frames": num_frames}
    return json.dumps(body, allow_nan=False, indent=2)
