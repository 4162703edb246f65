"""Closed-form cases of the engine's operators."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.functions import colors, labels
from pointlake.functions.numerics import clamped_bin, strict_bin
from pointlake.functions.polygons import bev_iou, iou_3d, overlap_area
from pointlake.operators import clusters, evaluation, grid, ground, matching, obb, quality, roi, timing, voxel
from pointlake.operators.components import connected_components
from pointlake.plans import config as configs
from pointlake.plans import detect
from pointlake.sources import boxes as box_files
from pointlake.sources import scans


def cloud(spark, xyz, frame=0, **more):
    rows = [(frame, i, *map(float, p[:3]), *[v[i] for v in more.values()]) for i, p in enumerate(xyz)]
    extra = "".join(f", {k} int" for k in more)
    return spark.createDataFrame(rows, f"frame_id int, point_id long, x float, y float, z float{extra}")


def labelled(df, column="cluster_id"):
    got = {}
    for r in df.collect():
        if r[column] is not None:
            got.setdefault(r[column], set()).add(r.point_id)
    return sorted(map(sorted, got.values()))


# --- filters ---


def test_region_is_closed(spark):
    points = cloud(spark, [(0, 0, 0), (1, 1, 1), (1.01, 0, 0), (-0.01, 0, 0)])
    assert [r.point_id for r in roi.crop(points, roi.Roi(0, 1, -1, 1, -0.5, 1)).orderBy("point_id").collect()] == [0, 1]
    with pytest.raises(ValueError):
        roi.Roi(1, 1)
    with pytest.raises(ValueError):
        roi.Roi.from_config({"preprocess": {"roi": {"x_min": 0}}})


def test_region_reaches_the_scan(spark, tmp_path):
    cloud(spark, [(0, 0, 0)]).write.parquet(f"{tmp_path}/p")
    plan = roi.crop(spark.read.parquet(f"{tmp_path}/p").select("x", "y", "z"), roi.Roi())._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x" in plan.split("PushedFilters")[1]


def test_empty_cloud(spark):
    none = cloud(spark, [])
    assert roi.crop(none, roi.Roi()).count() == 0 and voxel.voxel_fixed(none, 0.1).count() == 0
    assert grid.dbscan_fixed(none, 0.5, 2).count() == 0 and grid.grid_components(none).count() == 0 and ground.segment_ground(none).count() == 0
    assert obb.fit_boxes(none.withColumn("cluster_id", F.lit(1))).count() == 0


def test_frame_ranges():
    assert roi.parse_frame_range("3-8", 20) == (3, 8, 1) and roi.parse_frame_range("8-20", 10) == (8, 10, 1) and roi.parse_frame_range("4", 9) == (4, 5, 1)
    for bad in ("", "x", "9-3", "30-40"):
        with pytest.raises(ValueError):
            roi.parse_frame_range(bad, 20)


def test_frame_step(spark):
    frames = spark.range(100).select(F.col("id").cast("int").alias("frame_id"))
    assert [r.frame_id for r in roi.frame_range(frames, 5, 12, 2).orderBy("frame_id").collect()] == [5, 7, 9, 11]


def test_even_sample(spark):
    points = cloud(spark, [(0, 0, 0)] * 23)
    for n in (1, 2, 5, 22, 23, 40):
        got = sorted(r.point_id for r in roi.even_sample(points, n).collect())
        assert got == (list(range(23)) if n >= 23 else sorted(set(np.linspace(0, 22, n).astype(int).tolist())) if n > 1 else [0])


# --- voxels ---


def test_voxel_keys_are_single_precision(spark):
    points = cloud(spark, [(0.3, -0.05, 0), (0.29, -0.1, 0)])
    got = {(r.vx, r.vy) for r in voxel.voxel_fixed(points, 0.1).collect()}
    want = {tuple(int(v) for v in np.floor(np.float32(p) / np.float32(0.1))) for p in ((0.3, -0.05), (0.29, -0.1))}
    assert got == want


def test_adaptive_voxels_clamp_and_add_up(spark):
    points = cloud(spark, [(0, 0, 0), (20, 0, 0), (60, 0, 0), (75, 0, 0)])
    stats = {r.bin: (r.input_points, r.output_points) for r in voxel.voxel_bin_stats(points, [0, 20, 40, 60], [0.05, 0.1, 0.15]).collect()}
    assert stats == {0: (1, 1), 1: (1, 1), 2: (2, 2)}
    with pytest.raises(ValueError):
        voxel.voxel_adaptive(points, [0, 20], [1, 2])
    with pytest.raises(ValueError):
        voxel.downsample(points, {"preprocess": {"voxel": {"mode": "other"}}})


# --- clustering ---


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(0)
    for n, m in ((30, 20), (200, 150), (50, 400)):
        edges = rng.integers(0, n, (m, 2)).tolist()
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
        nodes = {x for a, b in edges if a != b for x in (a, b)}
        assert got == {x: find(x) for x in nodes}
    chain = spark.range(300).selectExpr("id AS src", "id + 1 AS dst")
    assert {r.component for r in connected_components(chain).collect()} == {0}


def test_cells_touch_at_corners(spark):
    points = cloud(spark, [(0, 0, 0), (0.1, 0.1, 1), (1.1, 1.1, 0), (1.2, 1.2, 1), (9, 9, 0), (9, 9, 0.1)])
    assert labelled(grid.grid_components(points, 1.0, 1.0, 2)) == [[0, 1, 2, 3]]
    assert labelled(grid.grid_components(points, 1.0, 1.0, 5)) == []


def test_dbscan_borders_and_noise(spark):
    chain = [(0.5 * i, 0, 0) for i in range(5)]
    assert labelled(grid.dbscan_fixed(cloud(spark, chain), 0.5, 3)) == [[0, 1, 2, 3, 4]]
    assert labelled(grid.dbscan_fixed(cloud(spark, [(0, 0, 0), (5, 0, 0)]), 0.5, 2)) == []


def brute_dbscan(xyz, eps, least):
    near = [[j for j in range(len(xyz)) if math.dist(xyz[i], xyz[j]) <= eps] for i in range(len(xyz))]
    core = {i for i, n in enumerate(near) if len(n) >= least}
    label = {}
    for i in sorted(core):
        if i not in label:
            stack = [i]
            while stack:
                a = stack.pop()
                if a not in label:
                    label[a] = i
                    stack += [j for j in near[a] if j in core]
    for i in set(range(len(xyz))) - core:
        roots = [label[j] for j in near[i] if j in core]
        if roots:
            label[i] = min(roots)
    return label


def test_dbscan_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    xyz = [tuple(float(np.float32(v)) for v in p) for p in rng.uniform(-2, 2, (120, 3))]
    got = {r.point_id: r.cluster_id for r in grid.dbscan_fixed(cloud(spark, xyz), 0.7, 4).collect() if r.cluster_id is not None}
    assert got == brute_dbscan(xyz, 0.7, 4)


@pytest.mark.parametrize(("edge", "owned"), [(20, [3, 4, 0]), (40, [0, 3, 4])])
def test_adaptive_dbscan_joins_across_an_edge(spark, edge, owned):
    points = cloud(spark, [(edge + 0.1 * i, 0, 0) for i in range(-3, 4)])
    got = grid.dbscan_adaptive(points, [0, 20, 40, 60], [0.4, 0.6, 1.0], 2)
    assert labelled(got) == [[0, 1, 2, 3, 4, 5, 6]]
    stats = {r.bin: r.input_points for r in grid.distance_bin_stats(got, [0, 20, 40, 60]).collect()}
    assert [stats.get(i, 0) for i in range(3)] == owned


def test_adaptive_dbscan_keeps_objects_apart(spark):
    points = cloud(spark, [(20 + 0.1 * i, 0, 0) for i in range(-3, 4)] + [(23, 0, 0), (23.1, 0, 0), (23.2, 0, 0)])
    got = grid.dbscan_adaptive(points, [0, 20, 40, 60], [0.4, 0.6, 1.0], 2)
    assert labelled(got) == [[0, 1, 2, 3, 4, 5, 6], [7, 8, 9]]
    assert {r.cluster_id for r in clusters.dense_ids(got).collect()} == {0, 1}


def test_borrowed_points_alone_make_no_cluster(spark):
    got = grid.dbscan_adaptive(cloud(spark, [(19.45, 0, 0), (19.95, 0, 0)]), [0, 20, 40], [0.4, 0.6], 2)
    assert labelled(got) == []


def test_cluster_filter(spark):
    points = cloud(spark, [(i * 0.1, 0, i * 0.1) for i in range(10)] + [(5, 5, 0)] * 3, cluster_id=[0] * 10 + [1] * 3)
    keep = lambda **k: sorted({r.cluster_id for r in clusters.filter_clusters(points, clusters.ClusterFilter(**k)).collect()})
    assert keep() == [0, 1] and keep(min_points=4) == [0] and keep(max_points=9) == [1] and keep(min_height=0.5) == [0] and keep(max_height=0.1) == [1]
    assert keep(min_points=10, percentile_clip=10) == []  # the clip leaves eight
    assert clusters.filter_clusters(points, clusters.ClusterFilter(min_points=4, percentile_clip=10)).count() == 8
    with pytest.raises(ValueError):
        clusters.ClusterFilter(percentile_clip=50)


# --- ground ---


def test_wall_is_no_ground(spark):
    wall = cloud(spark, [(x, 0, z) for x in np.linspace(-2, 2, 11) for z in np.linspace(-1.8, -0.8, 9)])
    got = ground.segment_ground(wall)
    assert {(r.reason, r.is_ground) for r in got.collect()} == {("normal_constraint", False)}


def test_plane_with_three_above(spark):
    points = cloud(spark, [(x, y, -1) for x in range(7) for y in range(7)] + [(0, 0, 0.5), (1, 0, 0.7), (2, 0, 1.0)])
    got = ground.segment_ground(points)
    assert sorted(r.point_id for r in got.where("NOT is_ground").collect()) == [49, 50, 51]
    assert ground.ground_ratio(got).first().ground_ratio == pytest.approx(49 / 52)
    assert ground.frame_planes(points).first().normal_z > 0.99


def test_too_few_points_in_the_band(spark):
    points = cloud(spark, [(0, 0, -2), (1, 0, -2), (0, 1, 5), (1, 1, 5)])
    r = ground.frame_planes(points, ground.GroundRules(z_max=0)).first()
    assert (r.reason, r.fit_points) == ("insufficient_fit_points", 2)


# --- boxes ---


def test_box_of_five_points(spark):
    points = cloud(spark, [(0, 0, 0), (2, 0, 0), (2, 1, 1), (0, 1, 1), (1, 0.5, 0.5)], cluster_id=[0] * 5)
    r = obb.judge_boxes(obb.fit_boxes(points, z_percentile=0)).first()
    assert sorted((round(r.length, 6), round(r.width, 6))) == [1, 2] and r.height == pytest.approx(1) and r.valid


@pytest.mark.parametrize("angle", [0, 30, 90, 135])
def test_turned_rectangles(spark, angle):
    t = math.radians(angle)
    flat = [(u, v) for u in np.linspace(-2, 2, 9) for v in np.linspace(-0.5, 0.5, 5)]
    points = cloud(spark, [(3 + u * math.cos(t) - v * math.sin(t), -1 + u * math.sin(t) + v * math.cos(t), 0.1 * i) for i, (u, v) in enumerate(flat)], cluster_id=[0] * 45)
    r = obb.fit_boxes(points, z_percentile=0).first()
    assert r.center_x == pytest.approx(3, abs=1e-5) and r.center_y == pytest.approx(-1, abs=1e-5) and r.extent_x == pytest.approx(2, abs=1e-5) and r.extent_y == pytest.approx(0.5, abs=1e-5)
    assert abs(math.sin(r.yaw - t)) < 1e-5 and -math.pi / 2 < r.yaw <= math.pi / 2 + 1e-12


def test_degenerate_boxes(spark):
    square = cloud(spark, [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], cluster_id=[0] * 4)
    assert obb.fit_boxes(square).first().yaw == pytest.approx(math.pi / 2)
    line = obb.fit_boxes(cloud(spark, [(i, 0, 0) for i in range(4)], cluster_id=[0] * 4)).first()
    assert (line.extent_y, line.extent_z) == (1e-6, 1e-6)
    two = obb.judge_boxes(obb.fit_boxes(cloud(spark, [(0, 0, 0), (1, 0, 0)], cluster_id=[0, 0])), obb.BoxLimits(2)).first()
    assert two.reason == "fit_failed" and not two.valid
    small = obb.judge_boxes(obb.fit_boxes(square)).first()
    assert small.reason == "volume_too_small (0.000)"


def test_boxes_along_the_grid_do_not_follow_the_order_of_rows(spark):
    # the covariance is 0 but for rounding, whose sign differs by the order of the rows
    grid_points = [(21.1 + 0.1 * a, 8 + 0.37 * b, 0.04 * (a + b)) for a in (0, 0, 2) for b in (0, 1, 1, 3)]
    rng = np.random.default_rng(7)
    rows = [(f, int(i), *map(float, grid_points[i % 12])) for f in range(300) for i in rng.permutation(36)]
    points = spark.createDataFrame(rows, "frame_id int, point_id long, x float, y float, z float").withColumn("cluster_id", F.lit(0)).repartition(6, "point_id")
    boxes = obb.fit_boxes(points).collect()
    assert len(boxes) == 300 and {r.yaw for r in boxes} == {math.pi / 2}
    assert all(r.center_x == pytest.approx(21.2, abs=1e-5) and r.center_y == pytest.approx(8.555, abs=1e-5) for r in boxes)


def test_box_sides_carry_their_own_moments(spark):
    points = cloud(spark, [(0, 0, 0), (2, 0, 0), (2, 1, 1), (0, 1, 1)], cluster_id=[0] * 4)
    plan = obb.fit_boxes(points)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("covar_samp") == 1


def box_table(spark, boxes, ids=None):
    rows = [(0, i, 10, *map(float, b), True) for i, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "frame_id int, box_id int, semantic_id int, center_x double, center_y double, center_z double, length double, width double, height double, yaw double, valid boolean")
    return df.withColumns({"extent_x": F.col("length") / 2, "extent_y": F.col("width") / 2, "extent_z": F.col("height") / 2})


def test_first_box_wins(spark):
    boxes = box_table(spark, [(0, 0, 0, 1, 1, 1, 0), (0, 0, 0, 2, 2, 2, 0), (0, 0, 0, 4, 4, 4, 0.3)]).withColumn("valid", F.col("box_id") != 0)
    points = cloud(spark, [(0, 0, 0), (1, 1, 1), (1.5, 0, 0), (9, 9, 9)])
    assert {r.point_id: r.box_id for r in obb.points_in_boxes(points, boxes, cell=1.0).collect()} == {0: 1, 1: 1, 2: 2}


def pair(spark, a, b):
    names = ("center_x", "center_y", "center_z", "length", "width", "height", "yaw")
    df = spark.createDataFrame([tuple(map(float, (*a, *b)))], ", ".join(f"{p}{n} double" for p in ("a_", "b_") for n in names))
    df = df.withColumn("s", overlap_area("a_", "b_"))
    return df.select("s", bev_iou("a_", "b_", F.col("s")).alias("bev"), iou_3d("a_", "b_", F.col("s")).alias("full")).first()


def test_overlap(spark):
    unit = (0, 0, 0, 1, 1, 1, 0)
    assert pair(spark, unit, unit).full == pytest.approx(1)
    assert pair(spark, unit, (5, 0, 0, 1, 1, 1, 0)).bev == 0
    assert pair(spark, unit, (0.5, 0, 0, 1, 1, 1, 0)).bev == pytest.approx(1 / 3)
    assert pair(spark, unit, (0, 0, 0, 1, 1, 1, math.pi / 4)).s == pytest.approx(2 * (math.sqrt(2) - 1))
    assert pair(spark, unit, (0, 0, 3, 1, 1, 1, 0)).full == 0
    assert pair(spark, unit, (0, 0, 0, 0, 1, 1, 0)).bev == 0


# --- matching and metrics ---


def test_more_matches_beat_more_overlap():
    iou = np.array([[0.90, 0.51], [0.50, 0.49]])
    assert sorted(matching.assign(iou, iou >= 0.5)) == [(0, 1), (1, 0)]


def test_assignment_equals_all_permutations():
    rng = np.random.default_rng(2)
    for n, m in itertools.product(range(1, 6), range(1, 6)):
        iou = rng.random((n, m)).round(2)
        valid = iou > 0.4
        got = matching.assign(iou, valid)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) and all(valid[p] for p in got)
        count, total = matching.best_total(iou, valid)
        assert len(got) == count and sum(iou[p] for p in got) == pytest.approx(total)


def test_matching_by_parts(spark):
    rows = [(0, 0, 0, 0.9), (0, 0, 1, 0.51), (0, 1, 0, 0.5), (0, 1, 1, 0.49), (0, 5, 7, 0.8), (1, 0, 0, 0.6), (1, 2, 2, float("nan"))]
    got = matching.match_boxes(spark.createDataFrame(rows, "frame_id int, p_id int, r_id int, iou double"))
    assert sorted((r.frame_id, r.p_id, r.r_id) for r in got.collect()) == [(0, 0, 1), (0, 1, 0), (0, 5, 7), (1, 0, 0)]


def test_classes_must_agree(spark):
    a = box_table(spark, [(0, 0, 0, 1, 1, 1, 0)])
    assert matching.overlaps(a, a.withColumn("semantic_id", F.lit(30))).count() == 0
    assert matching.overlaps(a, a.withColumn("semantic_id", F.lit(252))).first().iou == pytest.approx(1)


def test_bins_and_metrics_add_up(spark):
    rows = [("tp", 5.0, 0.8), ("tp", 15.0, 0.6), ("fp", 25.0, None), ("fn", 10.0, None), ("fn", -1.0, None)]
    results = spark.createDataFrame(rows, "kind string, distance double, iou double")
    total = evaluation.metrics(results).first()
    assert (total.tp, total.fp, total.fn, total.precision) == (2, 1, 2, pytest.approx(2 / 3)) and total.mean_iou == pytest.approx(0.7)
    by = evaluation.metrics_by_distance(results, [0, 10, 20]).orderBy("bin").collect()
    assert [r.name for r in by] == ["0-10m", "10-20m", "20m+"] and by[2].fp == 1 and sum(r.tp for r in by) == 2
    assert evaluation.metrics(results.limit(0)).first().f1 == 0
    body = json.loads(evaluation.metrics_json(evaluation.metrics(results), evaluation.metrics_by_distance(results), {"distance_bins": [0.0, float("inf")]}, 1))
    assert body["config"]["distance_bins"] == [0.0, "inf"]
    assert [r.n for r in evaluation.iou_histogram(results).orderBy("bin").collect()] == [0, 0, 1, 1]


def test_reference_boxes_take_the_least_of_tied_classes(spark):
    xyz = [(x * 0.5, y * 0.3, 0.1 * x) for x in range(4) for y in range(4)]
    points = cloud(spark, xyz, instance_id=[1] * 16, semantic_id=[252] * 8 + [10] * 8)
    r = evaluation.reference_boxes(points).first()
    assert r.semantic_id == 10 and evaluation.reference_boxes(points, 17).count() == 0


# --- labels, colours, bins ---


def test_labels(spark):
    ids = spark.createDataFrame([(10,), (50,), (252,), (259,), (256,), (7,)], "s int")
    got = ids.select(labels.training_of(F.col("s")).alias("t"), labels.canonical(F.col("s")).alias("c"), labels.name_of(F.col("s")).alias("n")).collect()
    assert [r.t for r in got] == [1, 13, 1, 5, 5, 0] and [r.c for r in got] == [10, 50, 10, 20, 15, 7] and got[5].n == "unknown-7"
    assert [r.i for r in spark.createDataFrame([(1,), (13,)], "t int").select(labels.label_of_training(F.col("t")).alias("i")).collect()] == [10, 50]
    with pytest.raises(Exception, match="out of table"):
        ids.select(labels.training_of(F.col("s"), strict=True).alias("t")).collect()
    assert len(labels.NAMES) == len(labels.COLORS) == len(labels.TRAINING) == 34
    assert labels.target_ids({"Car": True, "pedestrian": True, "bus": False}) == {10, 252, 30, 254}
    with pytest.raises(ValueError):
        labels.target_ids("spaceship")


def test_packed_labels(spark):
    raw = spark.createDataFrame([(0xFFFFFFFF,), (0x00010000,), (0x0000FFFF,)], "r long")
    got = raw.select("r", labels.semantic_of(F.col("r")).alias("s"), labels.instance_of(F.col("r")).alias("i"))
    assert [(r.s, r.i) for r in got.collect()] == [(65535, 65535), (0, 1), (65535, 0)]
    assert all(r.r == r.p for r in got.select("r", labels.packed(F.col("s"), F.col("i")).alias("p")).collect())


def test_class_by_size(spark):
    cases = [(0, v, h) for v in (0.09, 0.1, 2.0, 2.01, 80.0, 81.0) for h in (1.19, 1.2)] + [(31, 1.0, 1.5)]
    got = spark.createDataFrame(cases, "s int, v double, h double").select(labels.class_from_size(F.col("s"), F.col("v"), F.col("h")).alias("c")).collect()
    assert [r.c for r in got] == [10, 10, 10, 30, 10, 30, 10, 10, 10, 10, 10, 10, 31]


def test_bins(spark):
    rows = spark.createDataFrame([(-1.0,), (0.0,), (20.0,), (39.9,), (60.0,), (99.0,)], "d double")
    got = rows.select(clamped_bin(F.col("d"), [0, 20, 40, 60]).alias("c"), strict_bin(F.col("d"), [0, 20, 40, float("inf")]).alias("s")).collect()
    assert [r.c for r in got] == [0, 0, 1, 1, 2, 2] and [r.s for r in got] == [None, 0, 1, 1, 2, 2]


def test_colours(spark):
    r = spark.range(1).select(colors.by_label(F.lit(10)).alias("a"), colors.by_label(F.lit(7)).alias("b"), F.array(*colors.by_height(F.lit(-5.0))).alias("c")).first()
    assert r.a == pytest.approx([100 / 255, 150 / 255, 245 / 255]) and r.b == [0.5] * 3 and r.c == [0, 0, 1]
    assert len(set(colors.palette(20))) == 20


# --- timing and quality ---


def test_timing(spark):
    clock = timing.Timings()
    for f, ms in ((0, 10.0), (1, 20.0)):
        clock.record("a", ms, f, 100)
        clock.record("b", 1.0, f)
    with clock.measure("c"):
        pass
    table = clock.table(spark)
    a = timing.module_stats(table).where("module = 'a'").first()
    assert (a["count"], a.mean_ms, a.std_ms, a.p50_ms, a.total_ms) == (2, 15, 5, 15, 30)
    assert timing.frame_stats(table).first().frames == 2 and timing.throughput(table).first().points_per_s == pytest.approx(200 / 0.03)
    body = timing.report(table)
    assert body["modules"][0]["module"] == "a" and "| a |" in timing.report_markdown(body) and json.loads(timing.report_json(body))
    clock.record("total", 50.0, 1)
    assert {r.frame_id: r.duration_ms for r in timing.frame_times(clock.table(spark)).collect()} == {0: 11.0, 1: 50.0}


def test_continuity(spark):
    rows = [(f, i, 10) for f in range(4) for i in (1, 2)] + [(4, 9, 10)]
    points = spark.createDataFrame(rows, "frame_id int, instance_id int, semantic_id int")
    r = quality.instance_continuity(points).first()
    assert (r.shared, r.total, r.passed) == (6, 8, True)
    assert not quality.instance_continuity(points.where("frame_id > 2")).first().passed


def test_prediction_checks(spark):
    a = spark.createDataFrame([(0, 5), (1, 5), (2, 5)], "frame_id int, points long")
    b = spark.createDataFrame([(0, 5), (1, 4), (3, 5)], "frame_id int, points long")
    assert {r.frame_id: r.problem for r in quality.prediction_checks(a, b).collect()} == {1: "point_count", 2: "missing", 3: "unexpected"}


# --- sources, sinks, plans ---


@pytest.fixture
def scan_root(tmp_path):
    base = tmp_path / "sequences" / "00"
    (base / "velodyne").mkdir(parents=True)
    (base / "labels").mkdir()
    rng = np.random.default_rng(0)
    for f in range(2):
        flat = np.stack([rng.uniform(1, 30, 400), rng.uniform(-9, 9, 400), np.full(400, -1.7), rng.random(400)], 1)
        car = np.stack([rng.uniform(10, 14, 300), rng.uniform(-1, 1, 300), rng.uniform(-1.2, 0.3, 300), rng.random(300)], 1)
        np.concatenate([flat, car]).astype("<f4").tofile(base / "velodyne" / f"{f:06d}.bin")
        np.array([40] * 400 + [10 | 1 << 16] * 300, "<u4").tofile(base / "labels" / f"{f:06d}.label")
    (base / "poses.txt").write_text("1 0 0 0 0 1 0 0 0 0 1 0\nshort line\n1 0 0 0.7 0 1 0 0 0 0 1 0\n")
    (base / "calib.txt").write_text("P0: 1 0 0 0 0 1 0 0 0 0 1 0\nTr: 0 0 0 1 0 0 0 1 0 0 0 1\nX: 1\n")
    return f"file://{tmp_path}", base


CONFIG = {
    "preprocess": {"voxel": {"voxel_size": 0.1}},
    "ground": {"num_iterations": 30, "z_max": -1.3},
    "proposals": {"method": "dbscan", "dbscan": {"mode": "fixed", "eps": 0.8, "min_points": 5}},
    "filtering": {"min_points": 20, "min_height": 0.3},
}


def test_scan_to_metrics(spark, scan_root, tmp_path):
    root, base = scan_root
    points = scans.read_labelled(spark, root, 0)
    assert points.count() == 1400 and {(r.semantic_id, r.instance_id) for r in points.select("semantic_id", "instance_id").distinct().collect()} == {(40, 0), (10, 1)}
    assert [r.points for r in scans.scan_info(spark, root, "00").orderBy("frame_id").collect()] == [700, 700]
    assert [r.frame_id for r in scans.read_scans(spark, root, "0", 1).select("frame_id").distinct().collect()] == [1]
    assert [(r.frame_id, r.pose[3]) for r in scans.read_poses(spark, f"{base}/poses.txt").collect()] == [(0, 0.0), (1, 0.7)]
    assert {r.key for r in scans.read_calibration(spark, f"{base}/calib.txt").collect()} == {"P0", "Tr"}
    found = detect.detect(points.drop("semantic_id", "instance_id"), CONFIG).cache()
    assert found.where("valid").groupBy("frame_id").count().count() == 2
    flat = found.drop("sequence")
    box_files.write_jsonl(box_files.nested(flat), f"{tmp_path}/b.jsonl")
    back = box_files.flattened(box_files.read_jsonl(spark, f"{tmp_path}/b.jsonl"))
    assert sorted((r.frame_id, r.box_id, r.yaw) for r in back.collect()) == sorted((r.frame_id, r.box_id, r.yaw) for r in flat.collect())
    box_files.write_parquet(flat, f"{tmp_path}/b.parquet")
    assert box_files.read_parquet(spark, f"{tmp_path}/b.parquet").count() == flat.count()
    total = evaluation.metrics(detect.evaluate(points, found, CONFIG | {"evaluation": {"targets": ["car"]}})).first()
    assert total.tp == 2 and total.fn == 0
    labelled_points = detect.point_labels(points, found)
    status = scans.write_labels(labelled_points, root).collect()
    assert all(r.error is None and r.points == 700 for r in status)
    again = scans.unpacked(scans.read_raw_labels(spark, root, "00", "predictions"))
    assert again.where("semantic_id > 0").count() == labelled_points.where("semantic_id > 0").count() > 0


def test_bad_files_fail(spark, scan_root, tmp_path):
    root, base = scan_root
    np.zeros(3, "<u4").tofile(base / "labels" / "000001.label")
    assert [(r.frame_id, r.failed) for r in quality.file_checks(scans.scan_info(spark, root, "00")).collect()] == [(1, "count_mismatch")]
    with pytest.raises(ValueError, match="frame 1"):
        scans.read_labelled(spark, root, "00")
    (tmp_path / "bad.jsonl").write_text("not valid json\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        box_files.read_jsonl(spark, f"{tmp_path}/bad.jsonl").collect()


def test_repeated_records(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (-1, 2, "c")], "frame_id int, line_no int, v string")
    assert [r.v for r in box_files.one_record_per_frame(rows).collect()] == ["b"] and [r.v for r in box_files.one_record_per_frame(rows, last=False).collect()] == ["a"]


def test_config_layers(tmp_path):
    (tmp_path / "base.yaml").write_text("a: {b: 1, c: 2}\n")
    (tmp_path / "detection.yaml").write_text("a: {c: 3}\nd: [1]\n")
    (tmp_path / "local.yaml").write_text("a: {b: 9}\n")
    assert configs.load(tmp_path, "detection") == {"a": {"b": 9, "c": 3}, "d": [1]}
    (tmp_path / "list.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        configs.read_yaml(tmp_path / "list.yaml")


def test_streams(spark, tmp_path):
    from pointlake import streaming

    events = spark.createDataFrame([(1, "a", 1.0, 0), (1, "a", 3.0, 60), (2, "b", 5.0, 4000)], "user_id long, event_type string, value double, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    events.write.parquet(f"{tmp_path}/in")
    stream = streaming.windowed_events(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.event_type, r.n, r.total) for r in spark.table("windows").where("event_type = 'a'").collect()] == [("a", 2, 4.0)]
