"""Further registered queries: ids local to a frame, contested matching, records of files, reports and display."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointlake.functions import colors, labels
from pointlake.operators import evaluation, grid, matching, quality, timing, voxel
from pointlake.plans import catalogue as base
from pointlake.plans import detect, display, views
from pointlake.plans.catalogue import query, r, rounded
from pointlake.session import materialise
from pointlake.sources import boxes as box_files
from pointlake.sources import scans

_OBJ, _PTS, _SCENE, _TIMING = base._OBJ, base._PTS, base._SCENE, base._TIMING

# --- configured stages, ids local to a frame -------------------------------------------------------


@query(base.ORACLE_SQL["voxel_fixed"])
def voxel_configured(spark, sf_dir):
    return rounded(voxel.downsample(views.pts(spark, sf_dir), {"preprocess": {"voxel": {"mode": "fixed", "voxel_size": 0.5}}}), "x", "y", "z")


def _local(sql: str) -> str:
    """The same clusters with ids counted within their frame."""
    return f"SELECT frame_id, point_id % 100000 AS point_id, cluster_id % 100000 AS cluster_id FROM ({sql})"


def _within_frames(spark, sf_dir):
    return views.obj(spark, sf_dir).withColumn("point_id", F.col("point_id") % 100000)


@query(_local(base.ORACLE_SQL["bev_cc"]))
def bev_cc_local_ids(spark, sf_dir):
    config = {"proposals": {"method": "bev_cc", "bev_cc": {"resolution": 1.0, "min_height": 1.2, "min_points": 10}}}
    return grid.propose(_within_frames(spark, sf_dir), config).select("frame_id", "point_id", "cluster_id")


@query(_local(base.ORACLE_SQL["dbscan_fixed"]))
def dbscan_local_ids(spark, sf_dir):
    config = {"proposals": {"method": "dbscan", "dbscan": {"mode": "fixed", "eps": 0.3, "min_points": 4}}}
    return grid.propose(_within_frames(spark, sf_dir), config).select("frame_id", "point_id", "cluster_id")


@query(_local(base.ORACLE_SQL["dbscan_adaptive"]))
def dbscan_adaptive_local_ids(spark, sf_dir):
    own = {"mode": "distance_adaptive", "distance_bins": list(base.EDGES), "bin_eps": list(base.EPS), "bin_min_points": list(base.LEAST)}
    return grid.propose(_within_frames(spark, sf_dir), {"proposals": {"method": "dbscan", "dbscan": own}}).select("frame_id", "point_id", "cluster_id")


# --- contested matching ----------------------------------------------------------------------------

# Two references and two predictions a box, moved along the box by parts of its length: two boxes apart by the part d
# of their length have the overlap (1 - d) / (1 + d).
_PARTS = {"r": ("0.0", "0.2 + 0.0503 * (instance_id % 4)"), "p": ("0.1007 * (instance_id % 3)", "0.31 + 0.017 * (instance_id % 5)")}
_SIDES = ", ".join(f"{side} AS (SELECT frame_id, instance_id AS g, instance_id * 2 + k AS id, k, CASE k WHEN 0 THEN {a} ELSE {b} END AS part FROM refs, (VALUES (0), (1)) v(k))" for side, (a, b) in _PARTS.items())


@query(
    f"""WITH {_OBJ}, {base._REFERENCE}, {_SIDES},
    pair AS (SELECT p.frame_id, p.g, p.id AS p_id, r.id AS r_id, (p.k + r.k) % 2 AS way, (1 - abs(p.part - r.part)) / (1 + abs(p.part - r.part)) AS iou FROM p JOIN r ON p.frame_id = r.frame_id AND p.g = r.g),
    edge AS (SELECT * FROM pair WHERE iou >= 0.5),
    total AS (SELECT frame_id, g, way, count(*) AS n, sum(iou) AS s FROM edge GROUP BY ALL),
    best AS (SELECT frame_id, g, arg_max(way, n * 10 + s) AS way FROM total GROUP BY ALL)
    SELECT frame_id, p_id, r_id, {r('iou', 4)} AS iou FROM edge JOIN best USING (frame_id, g, way)"""
)
def match_contested(spark, sf_dir):
    refs = materialise(evaluation.reference_boxes(views.obj(spark, sf_dir)), "references")

    def side(parts: tuple[str, str]):
        moved = refs.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("part", F.when(F.col("k") == 0, F.expr(parts[0])).otherwise(F.expr(parts[1])).cast("double"))
        along = F.col("part") * F.col("length")
        return moved.withColumns({"center_x": F.col("center_x") + along * F.cos("yaw"), "center_y": F.col("center_y") + along * F.sin("yaw"), "box_id": F.col("instance_id") * 2 + F.col("k")})

    pairs = matching.overlaps(side(_PARTS["p"]), side(_PARTS["r"])).where(F.expr("p_id div 2 = r_id div 2"))
    return rounded(matching.match_boxes(pairs, 0.5), "iou", digits=4)


# --- records of files --------------------------------------------------------------------------------

_RECORDS = "records AS (SELECT cast(user_id % 60 - 5 AS int) AS frame_id, event_id AS line_no, event_type FROM events)"


def _records(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("cast(user_id % 60 - 5 AS int) AS frame_id", "event_id AS line_no", "event_type")


@query(f"WITH {_RECORDS} SELECT frame_id, line_no, event_type FROM records WHERE frame_id >= 0 QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY line_no DESC) = 1")
def last_record(spark, sf_dir):
    return box_files.one_record_per_frame(_records(spark, sf_dir))


@query(f"WITH {_RECORDS} SELECT frame_id, line_no, event_type FROM records WHERE frame_id >= 0 QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY line_no) = 1")
def first_record(spark, sf_dir):
    return box_files.one_record_per_frame(_records(spark, sf_dir), last=False)


@query(f"WITH {_RECORDS} SELECT frame_id, count(*) AS n FROM records GROUP BY frame_id")
def available_frames(spark, sf_dir):
    return box_files.available_frames(_records(spark, sf_dir)).groupBy("frame_id").agg(F.count("*").alias("n"))


@query(
    f"WITH {base._OBJ}, {base._fit_sql('cluster_id')}, {base._NUMBERED} SELECT frame_id, cast(count(*) AS int) AS num_boxes, cast(count(*) FILTER (WHERE valid) AS int) AS num_valid_boxes, string_agg(box_id, ',' ORDER BY box_id) AS ids, "
    f"{r('sum(coalesce(volume, 0))', 3)} AS volume FROM boxes GROUP BY frame_id"
)
def boxes_nested_rows(spark, sf_dir):
    frames = base.boxes_nested(spark, sf_dir)
    ids = F.array_join(F.transform("boxes", lambda b: b["box_id"].cast("string")), ",")
    volume = F.aggregate("boxes", F.lit(0.0), lambda s, b: s + F.coalesce(b["volume"], F.lit(0.0)))
    return rounded(frames.select("frame_id", "num_boxes", "num_valid_boxes", ids.alias("ids"), volume.alias("volume")), "volume", digits=3)


_COUNTED = "SELECT frame_id, count(*) AS points FROM pts GROUP BY frame_id"
_FOUND = "SELECT CASE WHEN frame_id % 5 = 0 THEN frame_id + 1000000 ELSE frame_id END AS frame_id, points + CASE WHEN frame_id % 7 = 0 THEN 1 ELSE 0 END AS points FROM counted"


@query(
    f"WITH {_PTS}, counted AS ({_COUNTED}), found AS ({_FOUND}) SELECT coalesce(c.frame_id, f.frame_id) AS frame_id, CASE WHEN f.points IS NULL THEN 'missing' WHEN c.points IS NULL THEN 'unexpected' ELSE 'point_count' END AS problem "
    "FROM counted c FULL JOIN found f ON c.frame_id = f.frame_id WHERE c.points IS DISTINCT FROM f.points"
)
def prediction_checks(spark, sf_dir):
    counted = views.pts(spark, sf_dir).groupBy("frame_id").agg(F.count("*").alias("points"))
    found = counted.selectExpr("CASE WHEN frame_id % 5 = 0 THEN frame_id + 1000000 ELSE frame_id END AS frame_id", "points + CASE WHEN frame_id % 7 = 0 THEN 1 ELSE 0 END AS points")
    return quality.prediction_checks(counted, found)


@query(f"WITH {_PTS}, counted AS ({_COUNTED}) SELECT count(*) AS frames, count(*) FILTER (WHERE frame_id % 4 <> 0) AS exported, count(*) FILTER (WHERE frame_id % 4 = 0) AS failed, cast(sum(points) FILTER (WHERE frame_id % 4 <> 0) AS bigint) AS points FROM counted")
def export_totals(spark, sf_dir):
    counted = views.pts(spark, sf_dir).groupBy("frame_id").agg(F.count("*").alias("points"))
    done = counted.where("frame_id % 4 <> 0 OR frame_id % 8 = 0").withColumn("error", F.when(F.col("frame_id") % 8 == 0, F.lit("disk")))
    return scans.export_totals(counted, done)


# --- labels, metrics, reports ------------------------------------------------------------------------

@query(
    f"WITH {_OBJ}, rec AS (SELECT frame_id, point_id, CASE WHEN point_id % 3 = 0 THEN semantic_id ELSE 0 END AS semantic_id, cast(CASE WHEN point_id % 5 = 0 THEN 18 END AS int) AS class_id, CASE point_id % 4 WHEN 0 THEN ' Pedestrian' WHEN 1 THEN 'moving-bus' WHEN 2 THEN 'cow' END AS class_name, cast(instance_id AS double) AS volume, abs(z) AS height FROM obj) "
    "SELECT frame_id, point_id, cast(CASE WHEN semantic_id > 0 THEN semantic_id WHEN class_id > 0 THEN class_id WHEN class_name = ' Pedestrian' THEN 30 WHEN class_name = 'moving-bus' THEN 257 WHEN volume BETWEEN 0.1 AND 2 AND height >= 1.2 THEN 30 ELSE 10 END AS int) AS class_id FROM rec"
)
def class_from_record(spark, sf_dir):
    rec = views.obj(spark, sf_dir).selectExpr("frame_id", "point_id", "CASE WHEN point_id % 3 = 0 THEN semantic_id ELSE 0 END AS semantic_id", "CASE WHEN point_id % 5 = 0 THEN 18 END AS class_id", "CASE point_id % 4 WHEN 0 THEN ' Pedestrian' WHEN 1 THEN 'moving-bus' WHEN 2 THEN 'cow' END AS class_name", "cast(instance_id AS double) AS volume", "abs(z) AS height")
    return rec.select("frame_id", "point_id", labels.class_from_record(*[F.col(c) for c in ("semantic_id", "class_id", "class_name", "volume", "height")]).alias("class_id"))


@query(f"SELECT class_id AS semantic_id, cast(sum(n) AS bigint) AS points FROM ({base._labels_sql(base._NUMBERED)}) GROUP BY class_id")
def label_coverage(spark, sf_dir):
    boxes = base._valid_boxes(spark, sf_dir).withColumn("semantic_id", F.lit(0))
    return detect.coverage(detect.point_labels(views.pts(spark, sf_dir), boxes))


_SEEN = "seen AS (SELECT semantic_id AS t, CASE WHEN point_id % 5 = 0 THEN 50 ELSE semantic_id END AS q, x, y FROM obj)"
_SUMMARY = """k AS (SELECT {by} t AS class FROM seen UNION SELECT {by} q FROM seen),
    each AS (SELECT {kby} class, count(*) FILTER (WHERE t = class AND q = class) AS tp, count(*) FILTER (WHERE t <> q) AS wrong FROM k JOIN seen ON (t = class OR q = class) {on} GROUP BY ALL)"""


def _pairs(spark, sf_dir):
    return views.obj(spark, sf_dir).selectExpr("semantic_id AS true_id", "CASE WHEN point_id % 5 = 0 THEN 50 ELSE semantic_id END AS pred_id", "x", "y")


@query(f"WITH {_OBJ}, {_SEEN}, {_SUMMARY.format(by='', kby='', on='')} SELECT count(*) AS classes, {r('avg(tp / (tp + wrong))')} AS mean_iou, (SELECT {r('avg(CASE WHEN t = q THEN 1e0 ELSE 0e0 END)')} FROM seen) AS accuracy FROM each")
def semantic_summary(spark, sf_dir):
    return rounded(evaluation.semantic_summary(_pairs(spark, sf_dir)), "mean_iou", "accuracy")


_BINNED = "seen AS (SELECT t, q, CASE WHEN d < 10 THEN '0-10m' WHEN d < 20 THEN '10-20m' WHEN d < 30 THEN '20-30m' WHEN d < 40 THEN '30-40m' ELSE '40-50m' END AS bin FROM (SELECT t, q, sqrt(cast(x AS double) * x + cast(y AS double) * y) AS d FROM whole) WHERE d < 50)"


@query(
    f"WITH {_OBJ}, {_SEEN.replace('seen AS', 'whole AS')}, {_BINNED}, {_SUMMARY.format(by='bin,', kby='k.bin,', on='AND k.bin = seen.bin')}, acc AS (SELECT bin, avg(CASE WHEN t = q THEN 1e0 ELSE 0e0 END) AS a FROM seen GROUP BY bin) "
    f"SELECT bin, count(*) AS classes, {r('avg(tp / (tp + wrong))')} AS mean_iou, {r('any_value(a)')} AS accuracy FROM each JOIN acc USING (bin) GROUP BY bin"
)
def semantic_summary_by_distance(spark, sf_dir):
    return rounded(evaluation.semantic_summary(evaluation.with_distance_bin(_pairs(spark, sf_dir)), ["bin"]), "mean_iou", "accuracy")


@query(f"SELECT {r('avg(iou)')} AS mean_iou, cast(3 - count(*) AS bigint) AS missing FROM ({base.ORACLE_SQL['semantic_iou']}) WHERE class IN (10, 30)")
def subset_mean(spark, sf_dir):
    per = base.semantic_iou(spark, sf_dir).select(labels.name_of(F.col("class")).alias("name"), "iou")
    return rounded(evaluation.class_subset_mean(per, ["car", "person", "unicorn"]), "mean_iou").select("mean_iou", F.col("missing").cast("long").alias("missing"))


@query(f"SELECT module, total_ms FROM ({base.ORACLE_SQL['perf_modules']}) ORDER BY total_ms DESC, module LIMIT 3")
def perf_slowest(spark, sf_dir):
    return rounded(timing.slowest(views.timing(spark, sf_dir), 3).select("module", "total_ms"), "total_ms", digits=3)


@query(f"WITH {_TIMING} SELECT count(DISTINCT frame_id) AS total_frames, {r('sum(duration_ms)', 3)} AS total_time_ms, cast(1000000 AS bigint) AS total_points, {r('1000000 * 1000 / sum(duration_ms)', 3)} AS points_per_second FROM timing")
def perf_summary(spark, sf_dir):
    return rounded(timing.summary(views.timing(spark, sf_dir), 1_000_000), "total_time_ms", "points_per_second", digits=3)


# --- display -----------------------------------------------------------------------------------------

_SHOWN = {"visualization": {"display_roi": {"x_min": 10, "x_max": 40, "y_min": -20}}}


@query(f"SELECT frame_id, instance_id FROM (WITH {_OBJ}, {base._REFERENCE} SELECT * FROM refs) WHERE center_x BETWEEN 10 AND 40 AND center_y BETWEEN -20 AND 40")
def display_boxes(spark, sf_dir):
    return display.in_display(evaluation.reference_boxes(views.obj(spark, sf_dir)), display.display_bounds(_SHOWN)).select("frame_id", "instance_id")


@query(
    f"WITH {_OBJ}, {base._REFERENCE}, {base._SIGNS}, c AS (SELECT frame_id, instance_id AS box_id, c + 4 * up AS corner, center_x + sx * length / 2 * cos(yaw) - sy * width / 2 * sin(yaw) AS x, center_y + sx * length / 2 * sin(yaw) + sy * width / 2 * cos(yaw) AS y, center_z + (up - 0.5) * height AS z FROM refs, signs, (VALUES (0), (1)) u(up)), "
    f"e(edge, a, b) AS (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(display.EDGES))}) "
    f"SELECT a.frame_id, a.box_id, e.edge, {', '.join(f'{r(f'{t}.{v}', 4)} AS {t}{v}' for t in 'ab' for v in 'xyz')} FROM e JOIN c a ON a.corner = e.a JOIN c b ON b.corner = e.b AND b.frame_id = a.frame_id AND b.box_id = a.box_id"
)
def box_edges(spark, sf_dir):
    refs = evaluation.reference_boxes(views.obj(spark, sf_dir)).withColumn("box_id", F.col("instance_id"))
    return rounded(display.box_edges(refs), *(f"{t}{v}" for t in "ab" for v in "xyz"), digits=4)


def _rgb(df, column: str):
    return df.select("frame_id", "point_id", *[F.col(column)[i].alias(n) for i, n in enumerate(("red", "green", "blue"))])


def _colour_sql(k: int) -> str:
    return "CASE semantic_id " + " ".join(f"WHEN {i} THEN {c[k] / 255!r}" for i, c in labels.COLORS.items()) + " ELSE 0.5 END"


@query(f"WITH {_OBJ} SELECT frame_id, point_id, {', '.join(f'{r(_colour_sql(k))} AS {n}' for n, k in (('red', 2), ('green', 1), ('blue', 0)))} FROM obj")
def label_color(spark, sf_dir):
    return rounded(_rgb(views.obj(spark, sf_dir).withColumn("c", colors.by_label(F.col("semantic_id"))), "c"), "red", "green", "blue")


@query(f"WITH {_SCENE} SELECT frame_id, point_id, {', '.join(f'CASE WHEN z < cast(-1.2 AS float) THEN {g}e0 ELSE {o}e0 END AS {n}' for n, g, o in zip(('red', 'green', 'blue'), colors.GROUND, colors.OBJECT, strict=True))} FROM scene")
def ground_color(spark, sf_dir):
    low = F.col("z") < F.lit(-1.2).cast("float")
    return _rgb(views.scene(spark, sf_dir).withColumn("c", colors.by_ground(low)), "c")


# --- whole detection, without SQL ---------------------------------------------------------------------

_CONFIG = {
    "preprocess": {"voxel": {"mode": "fixed", "voxel_size": 0.1}},
    "ground": {"num_iterations": 40, "z_max": -1.2},
    "filtering": {"min_points": 10, "max_points": 1000, "percentile_clip": 2},
    "bev_cc": {"resolution": 0.5, "min_height": 0.3, "min_points": 10},
    "dbscan_fixed": {"mode": "fixed", "eps": 0.6, "min_points": 4},
    "dbscan_adaptive": {"mode": "distance_adaptive", "distance_bins": [0, 20, 40, 60], "bin_eps": [0.6, 0.8, 1.0], "min_points": 4},
    "evaluation": {"iou_threshold": 0.25, "target_semantic_ids": [10, 30]},
    "ablation": {"methods": [{"name": "bev_cc"}, {"name": "dbscan_fixed"}, {"name": "dbscan_adaptive"}]},
}


def _labelled_scene(spark, sf_dir):
    names = ("instance_id", "semantic_id")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*[f"{e} AS {n}" for n, e in {**views.SCENE, **{n: f"CASE WHEN l_linenumber = 1 THEN 0 ELSE {views.OBJ[n]} END" for n in names}}.items()])


@query()
def ablation_methods(spark, sf_dir):
    """Detection by each of the three proposal methods against the labelled scene; times are left out, since they differ by run."""
    points = materialise(_labelled_scene(spark, sf_dir), "scene")
    return detect.ablate(points, _CONFIG, detect.proposal_methods(_CONFIG)).drop("mean_ms")


@query()
def overlay_counts(spark, sf_dir):
    points = materialise(_labelled_scene(spark, sf_dir), "scene")
    boxes = materialise(detect.detect(points, _CONFIG | {"proposals": {"method": "dbscan", "dbscan": _CONFIG["dbscan_fixed"]}}), "boxes")
    return display.overlay_counts(materialise(display.overlay(points, boxes, _CONFIG | _SHOWN), "overlay"))


@query()
def stage_points(spark, sf_dir):
    shown = display.stage_points(views.scene(spark, sf_dir), _CONFIG | {"proposals": {"method": "bev_cc", "bev_cc": _CONFIG["bev_cc"]}})
    return shown.groupBy("frame_id", "is_ground").agg(F.count("*").alias("points"), F.countDistinct("cluster_id").alias("clusters"))
