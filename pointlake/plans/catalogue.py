"""The registered queries of the engine's own operators, each with SQL for the same rows.

Floating-point results are rounded on both sides; ids are least point ids, so clusters compare
without renumbering.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.functions import colors, labels
from pointlake.functions.polygons import bev_iou, iou_3d, overlap_area
from pointlake.operators import clusters, evaluation, grid, ground, matching, obb, quality, roi, timing, voxel
from pointlake.plans import views
from pointlake.session import materialise
from pointlake.sources import boxes as box_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ROI = roi.Roi(5.0, 50.0, -30.0, 30.0, -2.0, 2.0)
EDGES, SIZES, EPS, LEAST = (0.0, 20.0, 40.0, 60.0), (0.5, 1.0, 2.0), (0.6, 1.0, 1.5), (4, 4, 3)
GROUND = ground.GroundRules(distance_threshold=0.2, num_iterations=40, seed=0, z_max=-1.2)
FILTER = clusters.ClusterFilter(30, 50, 0.3, 4.0, 2.0)


def query(sql: str | None = None):
    """Registers a function under its name, with SQL if given."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Rounds columns; negative zero becomes zero."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) + F.lit(0.0) for n in names})


def r(expression: str, digits: int = 6) -> str:
    return f"round(cast({expression} AS double), {digits}) + 0e0"


_PTS, _OBJ, _SCENE = f"pts AS ({views.sql(views.PTS)})", f"obj AS ({views.sql(views.OBJ)})", f"scene AS ({views.sql(views.SCENE)})"
_TIMING = f"timing AS ({views.sql(views.TIMING, 'events')})"
_IN_ROI = "x BETWEEN cast(5 AS float) AND cast(50 AS float) AND y BETWEEN cast(-30 AS float) AND cast(30 AS float) AND z BETWEEN cast(-2 AS float) AND cast(2 AS float)"


# --- filters -------------------------------------------------------------------------------------


@query(f"WITH {_PTS} SELECT frame_id, point_id, {r('x')} AS x, {r('y')} AS y, {r('z')} AS z FROM pts WHERE {_IN_ROI}")
def roi_filter(spark, sf_dir):
    return rounded(roi.crop(views.pts(spark, sf_dir), ROI), "x", "y", "z")


@query(f"WITH {_PTS} SELECT frame_id, count(*) AS input_points, count(*) FILTER (WHERE {_IN_ROI}) AS output_points FROM pts GROUP BY frame_id")
def roi_counts(spark, sf_dir):
    return roi.crop_counts(views.pts(spark, sf_dir), ROI)


@query(f"WITH {_PTS} SELECT frame_id, point_id FROM pts WHERE z >= cast(-2.5 AS float) AND z <= cast(-0.5 AS float)")
def height_band(spark, sf_dir):
    return roi.height_band(views.pts(spark, sf_dir), -2.5, -0.5).select("frame_id", "point_id")


@query(f"WITH {_PTS} SELECT frame_id, count(*) AS n FROM pts WHERE frame_id >= 2 AND frame_id < 20 AND (frame_id - 2) % 3 = 0 GROUP BY frame_id")
def frame_range(spark, sf_dir):
    return roi.frame_range(views.pts(spark, sf_dir), 2, 20, 3).groupBy("frame_id").agg(F.count("*").alias("n"))


@query(
    f"WITH {_PTS}, q AS (SELECT frame_id, CASE point_id % 97 WHEN 0 THEN cast('nan' AS float) WHEN 1 THEN cast('inf' AS float) ELSE x END AS x FROM pts) "
    "SELECT frame_id, count(*) AS nonfinite FROM q WHERE isnan(x) OR isinf(x) GROUP BY frame_id"
)
def nonfinite_points(spark, sf_dir):
    x = F.when(F.col("point_id") % 97 == 0, F.lit(float("nan"))).when(F.col("point_id") % 97 == 1, F.lit(float("inf"))).otherwise(F.col("x"))
    return roi.nonfinite_counts(views.pts(spark, sf_dir).withColumn("x", x.cast("float")))


@query(
    f"WITH {_OBJ}, n AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY point_id) - 1 AS pos, count(*) OVER (PARTITION BY frame_id) AS n FROM obj), "
    "k AS (SELECT unnest(range(0, 50)) AS i) SELECT DISTINCT frame_id, point_id FROM n JOIN k ON n <= 50 OR pos = floor(i * (n - 1) / 49e0)"
)
def even_sample(spark, sf_dir):
    return roi.even_sample(views.obj(spark, sf_dir), 50).select("frame_id", "point_id")


# --- voxels --------------------------------------------------------------------------------------


def _cell(c: str, size: str) -> str:
    return f"cast(floor({c} / cast({size} AS float)) AS bigint)"


_CENTROID = ", ".join(f"{r(f'cast(avg(cast({c} AS double)) AS float)')} AS {c}" for c in "xyz") + ", count(*) AS n"


@query(f"WITH {_PTS} SELECT frame_id, {', '.join(f'{_cell(c, 0.5)} AS v{c}' for c in 'xyz')}, {_CENTROID} FROM pts GROUP BY ALL")
def voxel_fixed(spark, sf_dir):
    return rounded(voxel.voxel_fixed(views.pts(spark, sf_dir), 0.5), "x", "y", "z")


_RANGE = "sqrt(x * x + y * y)"
_BIN = f"(CASE WHEN {_RANGE} >= 20 THEN 1 ELSE 0 END + CASE WHEN {_RANGE} >= 40 THEN 1 ELSE 0 END)"
_BINNED = f"binned AS (SELECT *, cast({_BIN} AS int) AS bin, cast(CASE {_BIN} WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 2.0 END AS float) AS size FROM pts)"
_ADAPTIVE = f"WITH {_PTS}, {_BINNED}, cells AS (SELECT frame_id, bin, {', '.join(f'{_cell(c, chr(115) + chr(105) + chr(122) + chr(101))} AS v{c}' for c in 'xyz')}, {_CENTROID} FROM binned GROUP BY ALL)"


@query(f"{_ADAPTIVE} SELECT * FROM cells")
def voxel_adaptive(spark, sf_dir):
    return rounded(voxel.voxel_adaptive(views.pts(spark, sf_dir), EDGES, SIZES), "x", "y", "z")


@query(f"{_ADAPTIVE} SELECT frame_id, bin, cast(sum(n) AS bigint) AS input_points, count(*) AS output_points FROM cells GROUP BY frame_id, bin")
def voxel_bin_stats(spark, sf_dir):
    return voxel.voxel_bin_stats(views.pts(spark, sf_dir), EDGES, SIZES)


# --- labels --------------------------------------------------------------------------------------

_RAW = "raw AS (SELECT frame_id, point_id, cast(semantic_id AS bigint) | (cast(instance_id AS bigint) << 16) AS raw_label FROM obj)"


def _case(table: dict, column: str, otherwise: str) -> str:
    return f"CASE {column} {' '.join(f'WHEN {k} THEN {repr(v)}' for k, v in table.items())} ELSE {otherwise} END"


@query(f"WITH {_OBJ}, {_RAW} SELECT frame_id, point_id, raw_label FROM raw")
def label_pack(spark, sf_dir):
    return views.obj(spark, sf_dir).select("frame_id", "point_id", labels.packed(F.col("semantic_id"), F.col("instance_id")).alias("raw_label"))


@query(f"WITH {_OBJ}, {_RAW} SELECT frame_id, point_id, cast(raw_label & 65535 AS int) AS semantic_id, cast(raw_label >> 16 AS int) AS instance_id FROM raw")
def label_unpack(spark, sf_dir):
    raw = label_pack(spark, sf_dir)
    return raw.select("frame_id", "point_id", labels.semantic_of(F.col("raw_label")).alias("semantic_id"), labels.instance_of(F.col("raw_label")).alias("instance_id"))


@query(f"WITH {_OBJ}, t AS (SELECT semantic_id, cast({_case(labels.TRAINING, 'semantic_id', '0')} AS int) AS training_id FROM obj) SELECT semantic_id, training_id, cast({_case(labels.TRAINING_INVERSE, 'training_id', '0')} AS int) AS back_id, count(*) AS n FROM t GROUP BY ALL")
def label_remap(spark, sf_dir):
    t = views.obj(spark, sf_dir).select("semantic_id", labels.training_of(F.col("semantic_id")).alias("training_id"))
    return t.withColumn("back_id", labels.label_of_training(F.col("training_id"))).groupBy("semantic_id", "training_id", "back_id").agg(F.count("*").alias("n"))


@query(f"WITH {_OBJ} SELECT frame_id, {_case(labels.NAMES, 'semantic_id', chr(39) + 'unknown-' + chr(39) + ' || semantic_id')} AS name, count(*) AS n FROM obj GROUP BY ALL")
def semantic_histogram(spark, sf_dir):
    counts = views.obj(spark, sf_dir).groupBy("frame_id", "semantic_id").agg(F.count("*").alias("n"))
    return counts.select("frame_id", labels.name_of(F.col("semantic_id")).alias("name"), "n")


@query(f"WITH {_OBJ} SELECT frame_id, count(DISTINCT CASE WHEN instance_id > 0 THEN instance_id END) AS instances FROM obj GROUP BY frame_id")
def instance_count(spark, sf_dir):
    return views.obj(spark, sf_dir).groupBy("frame_id").agg(F.countDistinct(F.when(F.col("instance_id") > 0, F.col("instance_id"))).alias("instances"))


@query(f"WITH {_OBJ} SELECT semantic_id, cast({_case(labels.CANONICAL, 'semantic_id', 'semantic_id')} AS int) AS canonical_id, semantic_id IN {labels.THINGS} AS thing, count(*) AS n FROM obj GROUP BY ALL")
def canonical_class(spark, sf_dir):
    c = F.col("semantic_id")
    return views.obj(spark, sf_dir).groupBy("semantic_id", labels.canonical(c).alias("canonical_id"), labels.is_thing(c).alias("thing")).agg(F.count("*").alias("n"))


@query(f"WITH {_OBJ} SELECT semantic_id, count(*) AS n FROM obj WHERE semantic_id IN (10, 252, 30, 254) GROUP BY semantic_id")
def target_filter(spark, sf_dir):
    return views.obj(spark, sf_dir).where(labels.admits(F.col("semantic_id"), labels.target_ids(["car", "Pedestrian"]))).groupBy("semantic_id").agg(F.count("*").alias("n"))


@query(f"WITH {_OBJ} SELECT semantic_id, count(*) AS n FROM obj WHERE semantic_id NOT IN {tuple(labels.NAMES)} GROUP BY semantic_id")
def invalid_labels(spark, sf_dir):
    return quality.invalid_labels(views.obj(spark, sf_dir))


# --- clustering ----------------------------------------------------------------------------------

_ORIGIN = "o AS (SELECT frame_id, min(x) AS x0, min(y) AS y0 FROM obj GROUP BY frame_id)"
_CELLED = f"celled AS (SELECT obj.*, {_cell('(x - x0)', 1)} AS cx, {_cell('(y - y0)', 1)} AS cy FROM obj JOIN o USING (frame_id))"


@query(f"WITH {_OBJ}, {_ORIGIN}, {_CELLED} SELECT frame_id, cx, cy, {r('max(z) - min(z)')} AS height, count(*) AS n FROM celled GROUP BY frame_id, cx, cy")
def bev_cell_heights(spark, sf_dir):
    return rounded(grid.cell_heights(views.obj(spark, sf_dir), 1.0), "height")


@query(
    f"""WITH RECURSIVE {_OBJ}, {_ORIGIN}, {_CELLED},
    cells AS (SELECT frame_id, cx, cy, min(point_id) AS node, count(*) AS n FROM celled GROUP BY ALL HAVING max(z) - min(z) >= cast(1.2 AS float)),
    reach(node, root) AS (
      SELECT node, node FROM cells
      UNION
      SELECT b.node, r.root FROM reach r JOIN cells a ON a.node = r.node JOIN cells b ON b.frame_id = a.frame_id AND abs(b.cx - a.cx) <= 1 AND abs(b.cy - a.cy) <= 1
    ), roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
    sized AS (SELECT root, sum(n) AS size FROM roots JOIN cells USING (node) GROUP BY root HAVING sum(n) >= 10)
    SELECT p.frame_id, p.point_id, s.root AS cluster_id FROM celled p
    LEFT JOIN cells c ON c.frame_id = p.frame_id AND c.cx = p.cx AND c.cy = p.cy LEFT JOIN roots r ON r.node = c.node LEFT JOIN sized s ON s.root = r.root"""
)
def bev_cc(spark, sf_dir):
    return grid.grid_components(views.obj(spark, sf_dir), 1.0, 1.2, 10).select("frame_id", "point_id", "cluster_id")


_NEAR = "near AS (SELECT a.frame_id, a.point_id AS a, b.point_id AS b FROM obj a JOIN obj b ON a.frame_id = b.frame_id AND (cast(a.x AS double) - b.x) * (cast(a.x AS double) - b.x) + (cast(a.y AS double) - b.y) * (cast(a.y AS double) - b.y) + (cast(a.z AS double) - b.z) * (cast(a.z AS double) - b.z) <= {e} * {e})"


@query(f"WITH {_OBJ}, {_NEAR.format(e=0.3)} SELECT frame_id, a AS point_id, count(*) AS degree FROM near GROUP BY frame_id, a")
def dbscan_degree(spark, sf_dir):
    return grid.degrees(views.obj(spark, sf_dir), 0.3)


_DBSCAN = """core AS (SELECT a AS node FROM near GROUP BY a HAVING count(*) >= 4),
    links AS (SELECT a, b FROM near WHERE a IN (SELECT node FROM core) AND b IN (SELECT node FROM core)),
    reach(node, root) AS (SELECT node, node FROM core UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
    roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
    border AS (SELECT b AS node, min(root) AS root FROM near JOIN roots ON roots.node = a WHERE b NOT IN (SELECT node FROM core) GROUP BY b),
    label AS (SELECT * FROM roots UNION ALL SELECT * FROM border)"""


@query(f"WITH RECURSIVE {_OBJ}, {_NEAR.format(e=0.3)}, {_DBSCAN} SELECT frame_id, point_id, root AS cluster_id FROM obj LEFT JOIN label ON node = point_id")
def dbscan_fixed(spark, sf_dir):
    return grid.dbscan_fixed(views.obj(spark, sf_dir), 0.3, 4).select("frame_id", "point_id", "cluster_id")


@query(
    f"""WITH RECURSIVE {_OBJ}, placed AS (SELECT *, {_RANGE} AS rr, {_BIN} AS own FROM obj),
    bins(bin, eps, least, low, high) AS (VALUES (0, 0.6, 4, 0, 20), (1, 1.0, 4, 20, 40), (2, 1.5, 3, 40, 60)),
    member AS (SELECT frame_id, point_id * 3 + bin AS node, point_id, bin, own, x, y, z, cast(cast(eps AS float) AS double) AS eps, least FROM placed, bins
      WHERE own = bin OR (own = bin - 1 AND rr >= cast(low AS float) - cast(eps AS float)) OR (own = bin + 1 AND rr <= cast(high AS float) + cast(eps AS float))),
    near AS (SELECT a.node AS a, b.node AS b, a.least FROM member a JOIN member b ON a.frame_id = b.frame_id AND a.bin = b.bin
      AND (cast(a.x AS double) - b.x) * (cast(a.x AS double) - b.x) + (cast(a.y AS double) - b.y) * (cast(a.y AS double) - b.y) + (cast(a.z AS double) - b.z) * (cast(a.z AS double) - b.z) <= a.eps * a.eps),
    core AS (SELECT a AS node FROM near GROUP BY a HAVING count(*) >= min(least)),
    links AS (SELECT a, b FROM near WHERE a IN (SELECT node FROM core) AND b IN (SELECT node FROM core)),
    reach(node, root) AS (SELECT node, node FROM core UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
    roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
    border AS (SELECT b AS node, min(root) AS root FROM near JOIN roots ON roots.node = a WHERE b NOT IN (SELECT node FROM core) GROUP BY b),
    label AS (SELECT * FROM roots UNION ALL SELECT * FROM border),
    local AS (SELECT label.root, point_id FROM label JOIN member USING (node)),
    owned AS (SELECT DISTINCT label.root FROM label JOIN member USING (node) WHERE bin = own),
    mine AS (SELECT DISTINCT root, point_id FROM local WHERE root IN (SELECT root FROM owned)),
    shared AS (SELECT DISTINCT a.root AS a, b.root AS b FROM mine a JOIN mine b USING (point_id)),
    joined(a, top) AS (SELECT root, root FROM owned UNION SELECT s.b, j.top FROM joined j JOIN shared s ON s.a = j.a),
    tops AS (SELECT a AS root, min(top) AS top FROM joined GROUP BY a),
    final AS (SELECT DISTINCT point_id, top FROM mine JOIN tops USING (root)),
    ids AS (SELECT top, min(point_id) AS cluster_id FROM final GROUP BY top)
    SELECT obj.frame_id, obj.point_id, ids.cluster_id FROM obj LEFT JOIN final USING (point_id) LEFT JOIN ids USING (top)"""
)
def dbscan_adaptive(spark, sf_dir):
    return grid.dbscan_adaptive(views.obj(spark, sf_dir), EDGES, EPS, LEAST).select("frame_id", "point_id", "cluster_id")


_CLIP = ", ".join(f"cast(quantile_cont(cast({c} AS double), 0.02) AS float) AS {c}0, cast(quantile_cont(cast({c} AS double), 0.98) AS float) AS {c}1" for c in "xyz")
_FILTERED = f"""sized AS (SELECT frame_id, cluster_id, {_CLIP} FROM obj GROUP BY frame_id, cluster_id HAVING count(*) BETWEEN 30 AND 50),
    clipped AS (SELECT obj.* FROM obj JOIN sized USING (frame_id, cluster_id) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1),
    good AS (SELECT frame_id, cluster_id FROM clipped GROUP BY frame_id, cluster_id HAVING count(*) BETWEEN 30 AND 50 AND max(z) - min(z) BETWEEN cast(0.3 AS float) AND 4)"""


@query(f"WITH {_OBJ}, {_FILTERED} SELECT frame_id, cluster_id, point_id FROM clipped JOIN good USING (frame_id, cluster_id)")
def cluster_filter(spark, sf_dir):
    return clusters.filter_clusters(views.obj(spark, sf_dir), FILTER).select("frame_id", "cluster_id", "point_id")


@query(f"WITH {_OBJ} SELECT frame_id, count(*) AS input_points, count(DISTINCT cluster_id) AS num_clusters, count(cluster_id) AS clustered_points, {r('count(cluster_id) / count(DISTINCT cluster_id)')} AS mean_cluster_size FROM obj GROUP BY frame_id")
def cluster_stats(spark, sf_dir):
    return rounded(clusters.cluster_stats(views.obj(spark, sf_dir)), "mean_cluster_size")


@query(f"WITH {_OBJ}, f AS (SELECT frame_id, cluster_id, min(point_id) AS m FROM obj GROUP BY ALL), d AS (SELECT frame_id, cluster_id, cast(row_number() OVER (PARTITION BY frame_id ORDER BY m) - 1 AS int) AS dense_id FROM f) SELECT frame_id, dense_id, count(*) AS n FROM obj JOIN d USING (frame_id, cluster_id) GROUP BY ALL")
def cluster_numbers(spark, sf_dir):
    return clusters.dense_ids(views.obj(spark, sf_dir)).groupBy("frame_id", F.col("cluster_id").alias("dense_id")).agg(F.count("*").alias("n"))


# --- ground --------------------------------------------------------------------------------------

_HYPOTHESES = f"""band AS (SELECT frame_id, point_id, cast(x AS double) AS x, cast(y AS double) AS y, cast(z AS double) AS z FROM scene WHERE z <= cast(-1.2 AS float)),
    ranked AS (SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY x, y, z, point_id) - 1 AS i, x, y, z FROM band),
    sizes AS (SELECT frame_id, count(*) AS n FROM band GROUP BY frame_id HAVING count(*) >= 3),
    ks AS (SELECT unnest(range(0, 40)) AS k), js AS (SELECT unnest(range(0, 3)) AS j),
    draws AS (SELECT frame_id, k, j, {ground.DRAW.format(seed=0)} AS i FROM sizes, ks, js),
    drawn AS (SELECT * FROM draws JOIN ranked USING (frame_id, i)),
    three AS (SELECT frame_id, k, {', '.join(f'max(CASE WHEN j = {j} THEN {c} END) AS {c}{j}' for j in range(3) for c in 'xyz')} FROM drawn GROUP BY frame_id, k),
    nrm AS (SELECT *, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS a, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS b, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS c FROM three),
    planes AS (SELECT frame_id, k, a, b, c, -(a * x0 + b * y0 + c * z0) AS d FROM nrm WHERE a * a + b * b + c * c > 0),
    scored AS (SELECT frame_id, k, a, b, c, d, count(*) FILTER (WHERE abs(a * x + b * y + c * z + d) / sqrt(a * a + b * b + c * c) <= 0.2) AS inliers FROM planes JOIN band USING (frame_id) GROUP BY ALL),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY inliers DESC, k) = 1)"""


@query(f"WITH {_SCENE}, {_HYPOTHESES} SELECT frame_id, k, {', '.join(f'{r(c)} AS {c}' for c in 'abcd')} FROM planes")
def plane_hypotheses(spark, sf_dir):
    return rounded(ground.plane_hypotheses(views.scene(spark, sf_dir), GROUND), "a", "b", "c", "d")


@query(
    f"""WITH {_SCENE}, {_HYPOTHESES},
    judged AS (SELECT f.frame_id, a, b, c, d, CASE WHEN coalesce(n, 0) < 3 THEN 'insufficient_fit_points' WHEN a IS NULL THEN 'degenerate_plane' WHEN abs(c) / sqrt(a * a + b * b + c * c) < 0.9 THEN 'normal_constraint' END AS reason
      FROM (SELECT DISTINCT frame_id FROM scene) f LEFT JOIN sizes USING (frame_id) LEFT JOIN best USING (frame_id)),
    seg AS (SELECT s.frame_id, reason, coalesce(reason IS NULL AND abs(a * x + b * y + c * z + d) / sqrt(a * a + b * b + c * c) <= 0.2, false) AS is_ground FROM scene s JOIN judged USING (frame_id))
    SELECT frame_id, count(*) AS input_points, count(*) FILTER (WHERE is_ground) AS ground_points, {r('avg(CASE WHEN is_ground THEN 1e0 ELSE 0e0 END)')} AS ground_ratio, min(reason) AS reason FROM seg GROUP BY frame_id"""
)
def ground_segment(spark, sf_dir):
    return rounded(ground.ground_ratio(ground.segment_ground(views.scene(spark, sf_dir), GROUND)), "ground_ratio")


# --- boxes ---------------------------------------------------------------------------------------


def _fit_sql(group: str, source: str = "obj", least: int = 3) -> str:
    """Closed-form boxes of groups, as CTEs ending in ``fitted``."""
    return f"""mom AS (SELECT frame_id, {group}, count(*) AS num_points, avg(cast(x AS double)) AS mx, avg(cast(y AS double)) AS my, var_samp(cast(x AS double)) AS sxx, var_samp(cast(y AS double)) AS syy,
      covar_samp(cast(x AS double), cast(y AS double)) AS sxy, quantile_cont(cast(z AS double), 0.05) AS z0, quantile_cont(cast(z AS double), 0.95) AS z1 FROM {source} GROUP BY frame_id, {group} HAVING count(*) >= {least}),
    ang AS (SELECT *, CASE WHEN abs(sxx - syy) <= 1e-12 AND abs(sxy) <= 1e-12 THEN pi() / 2 ELSE atan2(2 * sxy, sxx - syy) / 2 END AS yaw FROM mom),
    loc AS (SELECT a.frame_id, a.{group}, a.num_points, mx, my, z0, z1, yaw, (p.x - mx) * cos(yaw) + (p.y - my) * sin(yaw) AS u, (p.y - my) * cos(yaw) - (p.x - mx) * sin(yaw) AS v FROM ang a JOIN {source} p ON p.frame_id = a.frame_id AND p.{group} = a.{group}),
    ext AS (SELECT frame_id, {group}, num_points, mx, my, z0, z1, yaw, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM loc GROUP BY ALL),
    fitted AS (SELECT frame_id, {group}, num_points, mx + (u0 + u1) / 2 * cos(yaw) - (v0 + v1) / 2 * sin(yaw) AS center_x, my + (u0 + u1) / 2 * sin(yaw) + (v0 + v1) / 2 * cos(yaw) AS center_y, (z0 + z1) / 2 AS center_z,
      greatest((u1 - u0) / 2, 1e-6) AS extent_x, greatest((v1 - v0) / 2, 1e-6) AS extent_y, greatest((z1 - z0) / 2, 1e-6) AS extent_z, yaw FROM ext)"""


_BOX = ("center_x", "center_y", "center_z", "extent_x", "extent_y", "extent_z", "yaw")


@query(f"WITH {_OBJ}, {_fit_sql('cluster_id')} SELECT frame_id, cluster_id, num_points, {', '.join(f'{r(c, 5)} AS {c}' for c in _BOX)} FROM fitted")
def obb_fit(spark, sf_dir):
    return rounded(obb.fit_boxes(views.obj(spark, sf_dir)).where("center_x IS NOT NULL"), *_BOX, digits=5)


_VOLUME = "8 * extent_x * extent_y * extent_z"
_VALID = f"""all_c AS (SELECT frame_id, cluster_id, count(*) AS num_points FROM obj GROUP BY frame_id, cluster_id),
    judged AS (SELECT a.frame_id, a.cluster_id, a.num_points, f.* EXCLUDE (frame_id, cluster_id, num_points), {_VOLUME} AS volume FROM all_c a LEFT JOIN fitted f ON f.frame_id = a.frame_id AND f.cluster_id = a.cluster_id)"""


@query(
    f"""WITH {_OBJ}, {_fit_sql('cluster_id')}, {_VALID} SELECT frame_id, cluster_id, num_points, {r('volume', 5)} AS volume,
    CASE WHEN num_points < 30 THEN 'insufficient_points' WHEN volume IS NULL THEN 'fit_failed' WHEN volume < 1.5 THEN 'volume_too_small' WHEN volume > 3.0 THEN 'volume_too_large' END AS reason,
    NOT (num_points < 30 OR volume IS NULL OR volume < 1.5 OR volume > 3.0) AS valid FROM judged"""
)
def obb_validity(spark, sf_dir):
    judged = obb.judge_boxes(obb.fit_boxes(views.obj(spark, sf_dir)), obb.BoxLimits(30, 1.5, 3.0))
    return rounded(judged.select("frame_id", "cluster_id", "num_points", "volume", F.regexp_replace("reason", r" \(.*", "").alias("reason"), "valid"), "volume", digits=5)


@query(
    f"""WITH {_OBJ}, {_fit_sql('cluster_id')}, {_VALID} SELECT frame_id, cluster_id, cast(CASE WHEN {_VOLUME} BETWEEN 0.1 AND 2.0 AND 2 * extent_z >= 1.2 THEN 30 ELSE 10 END AS int) AS class_id FROM fitted"""
)
def class_from_size(spark, sf_dir):
    boxes = obb.judge_boxes(obb.fit_boxes(views.obj(spark, sf_dir))).where("center_x IS NOT NULL")
    return boxes.select("frame_id", "cluster_id", labels.class_from_size(F.lit(0), F.col("volume"), F.col("height")).alias("class_id"))


_REFERENCE = f"""votes AS (SELECT frame_id, instance_id, semantic_id, count(*) AS n FROM obj WHERE instance_id > 0 GROUP BY ALL),
    cls AS (SELECT frame_id, instance_id, sum(n) AS total, arg_max(semantic_id, n * 100000 - semantic_id) AS semantic_id FROM votes GROUP BY ALL),
    own AS (SELECT o.* EXCLUDE (semantic_id), c.semantic_id FROM obj o JOIN cls c USING (frame_id, instance_id) WHERE total >= 10 AND c.semantic_id IN {labels.THINGS}),
    {_fit_sql('instance_id', 'own')},
    refs AS (SELECT f.*, c.semantic_id, 2 * extent_x AS length, 2 * extent_y AS width, 2 * extent_z AS height FROM fitted f JOIN cls c USING (frame_id, instance_id))"""


@query(f"WITH {_OBJ}, {_REFERENCE} SELECT frame_id, instance_id, semantic_id, num_points, {', '.join(f'{r(c, 5)} AS {c}' for c in ('center_x', 'center_y', 'center_z', 'length', 'width', 'height', 'yaw'))} FROM refs")
def reference_boxes(spark, sf_dir):
    names = ("center_x", "center_y", "center_z", "length", "width", "height", "yaw")
    return rounded(evaluation.reference_boxes(views.obj(spark, sf_dir)).select("frame_id", "instance_id", "semantic_id", "num_points", *names), *names, digits=5)


def _valid_boxes(spark, sf_dir, limits: obb.BoxLimits = obb.BoxLimits(30, 0.1, 1000)) -> DataFrame:
    return obb.numbered_boxes(obb.judge_boxes(obb.fit_boxes(views.obj(spark, sf_dir)), limits))


_NUMBERED = f"{_VALID}, boxes AS (SELECT *, num_points >= 30 AND volume BETWEEN 0.1 AND 1000 AS valid, cast(row_number() OVER (PARTITION BY frame_id ORDER BY cluster_id) - 1 AS int) AS box_id FROM judged)"
# points and faces closer than rounding would compare differently; boxes are widened a little on both sides
_HELD = "held AS (SELECT p.frame_id, p.point_id, min(b.box_id) AS box_id FROM pts p JOIN boxes b ON p.frame_id = b.frame_id AND b.valid AND abs((p.x - center_x) * cos(yaw) + (p.y - center_y) * sin(yaw)) <= extent_x AND abs((p.y - center_y) * cos(yaw) - (p.x - center_x) * sin(yaw)) <= extent_y AND abs(p.z - center_z) <= extent_z GROUP BY ALL)"


@query(f"WITH {_OBJ}, {_PTS}, {_fit_sql('cluster_id')}, {_NUMBERED}, {_HELD} SELECT * FROM held")
def points_in_boxes(spark, sf_dir):
    return obb.points_in_boxes(views.pts(spark, sf_dir), _valid_boxes(spark, sf_dir))


_CLASS = f"cast(CASE WHEN volume BETWEEN 0.1 AND 2.0 AND 2 * extent_z >= 1.2 THEN 30 ELSE 10 END AS int)"


def _labels_sql(numbered: str) -> str:
    return (
        f"WITH {_OBJ}, {_PTS}, {_fit_sql('cluster_id')}, {numbered}, {_HELD}, lab AS (SELECT p.frame_id, coalesce({_CLASS.replace('END AS', 'END AS')}, 0) AS class_id, h.box_id FROM pts p LEFT JOIN held h USING (frame_id, point_id) LEFT JOIN boxes b ON b.frame_id = p.frame_id AND b.box_id = h.box_id) "
        "SELECT frame_id, CASE WHEN box_id IS NULL THEN 0 ELSE class_id END AS class_id, count(*) AS n FROM lab GROUP BY ALL"
    )


# every box that can be fitted, of three points or more, gives its label
@query(_labels_sql(_NUMBERED.replace("num_points >= 30", "num_points >= 3")))
def boxes_to_labels(spark, sf_dir):
    boxes, points = _valid_boxes(spark, sf_dir, obb.BoxLimits()), views.pts(spark, sf_dir)
    classes = boxes.select("frame_id", "box_id", labels.class_from_size(F.lit(0), F.col("volume"), F.col("height")).alias("class_id"))
    held = obb.points_in_boxes(points, boxes).join(classes, ["frame_id", "box_id"])
    out = points.join(held, ["frame_id", "point_id"], "left").withColumn("class_id", F.coalesce("class_id", F.lit(0)))
    return out.groupBy("frame_id", "class_id").agg(F.count("*").alias("n"))


@query(f"WITH {_OBJ}, {_fit_sql('cluster_id')}, {_NUMBERED} SELECT frame_id, box_id, num_points, valid, cast(cluster_id AS int) AS cluster_id, {', '.join(f'{r(f'coalesce({c}, 0)', 5)} AS {c}' for c in (*_BOX, 'volume'))} FROM boxes")
def boxes_flat(spark, sf_dir):
    flat = _valid_boxes(spark, sf_dir).withColumns({"score": F.lit(1.0), "semantic_id": F.lit(0)})
    back = box_files.flattened(box_files.nested(flat))
    return rounded(back.select("frame_id", "box_id", F.col("num_points").cast("long").alias("num_points"), "valid", "cluster_id", *_BOX, "volume"), *_BOX, "volume", digits=5)


@query()
def boxes_nested(spark, sf_dir):
    return box_files.nested(_valid_boxes(spark, sf_dir).withColumns({"score": F.lit(1.0), "semantic_id": F.lit(0)}))


# --- overlap, matching, metrics ------------------------------------------------------------------


def _shifted(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """References, and predictions that are the references moved and turned by amounts that depend on their ids."""
    refs = materialise(evaluation.reference_boxes(views.obj(spark, sf_dir)).withColumn("box_id", F.col("instance_id")), "references")
    k = F.col("instance_id") % 7
    moved = refs.withColumns({"center_x": F.col("center_x") + 0.02 * k, "center_y": F.col("center_y") - 0.03 * k, "center_z": F.col("center_z") + 0.05 * k, "yaw": F.col("yaw") + 0.1 * k}).where("instance_id % 11 <> 0")
    return moved, refs  # references are fitted once; both sides are read several times


_PREDICTED = "preds AS (SELECT * REPLACE (center_x + 0.02 * (instance_id % 7) AS center_x, center_y - 0.03 * (instance_id % 7) AS center_y, center_z + 0.05 * (instance_id % 7) AS center_z, yaw + 0.1 * (instance_id % 7) AS yaw) FROM refs WHERE instance_id % 11 <> 0)"
# overlap by vertices: corners of each inside the other and edge crossings, sorted by angle around their mean, shoelace
_SIGNS = "signs(c, sx, sy) AS (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1))"


def _corner_sql(name: str, source: str, key: str) -> str:
    return f"{name} AS (SELECT frame_id, instance_id AS {key}, c, center_x + sx * length / 2 * cos(yaw) - sy * width / 2 * sin(yaw) AS x, center_y + sx * length / 2 * sin(yaw) + sy * width / 2 * cos(yaw) AS y FROM {source}, signs)"


def _inside_sql(point: str, box: str) -> str:
    return f"abs(({point}.x - {box}.center_x) * cos({box}.yaw) + ({point}.y - {box}.center_y) * sin({box}.yaw)) <= {box}.length / 2 + 1e-9 AND abs(({point}.y - {box}.center_y) * cos({box}.yaw) - ({point}.x - {box}.center_x) * sin({box}.yaw)) <= {box}.width / 2 + 1e-9"


_OVERLAP = f"""{_SIGNS}, {_corner_sql('pc', 'preds', 'id')}, {_corner_sql('rc', 'refs', 'id')},
    pe AS (SELECT a.frame_id, a.id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM pc a JOIN pc b ON a.frame_id = b.frame_id AND a.id = b.id AND b.c = (a.c + 1) % 4),
    re AS (SELECT a.frame_id, a.id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM rc a JOIN rc b ON a.frame_id = b.frame_id AND a.id = b.id AND b.c = (a.c + 1) % 4),
    cross1 AS (SELECT p.frame_id, p.id, p.x1, p.y1, p.x2, p.y2, r.x1 AS u1, r.y1 AS v1, r.x2 AS u2, r.y2 AS v2, (p.x2 - p.x1) * (r.y2 - r.y1) - (p.y2 - p.y1) * (r.x2 - r.x1) AS den FROM pe p JOIN re r ON p.frame_id = r.frame_id AND p.id = r.id),
    cross2 AS (SELECT frame_id, id, x1, y1, x2, y2, ((u1 - x1) * (v2 - v1) - (v1 - y1) * (u2 - u1)) / den AS t, ((u1 - x1) * (y2 - y1) - (v1 - y1) * (x2 - x1)) / den AS s FROM cross1 WHERE abs(den) > 1e-12),
    verts AS (
      SELECT pc.frame_id, pc.id, pc.x, pc.y FROM pc JOIN refs ON refs.frame_id = pc.frame_id AND refs.instance_id = pc.id AND {_inside_sql('pc', 'refs')}
      UNION ALL SELECT rc.frame_id, rc.id, rc.x, rc.y FROM rc JOIN preds ON preds.frame_id = rc.frame_id AND preds.instance_id = rc.id AND {_inside_sql('rc', 'preds')}
      UNION ALL SELECT frame_id, id, x1 + t * (x2 - x1), y1 + t * (y2 - y1) FROM cross2 WHERE t BETWEEN 0 AND 1 AND s BETWEEN 0 AND 1),
    mid AS (SELECT frame_id, id, x, y, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM verts WINDOW w AS (PARTITION BY frame_id, id)),
    ring AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY frame_id, id) AS n FROM mid WINDOW w AS (PARTITION BY frame_id, id ORDER BY atan2(y - my, x - mx))),
    shared AS (SELECT a.frame_id, a.id, abs(sum((a.x - a.mx) * (b.y - a.my) - (b.x - a.mx) * (a.y - a.my))) / 2 AS area FROM ring a JOIN ring b ON a.frame_id = b.frame_id AND a.id = b.id AND b.i = a.i % a.n + 1 GROUP BY ALL),
    iou AS (SELECT p.frame_id, p.instance_id AS id, coalesce(area, 0) / (p.length * p.width + r.length * r.width - coalesce(area, 0)) AS bev,
      coalesce(area, 0) * greatest(least(p.center_z + p.height / 2, r.center_z + r.height / 2) - greatest(p.center_z - p.height / 2, r.center_z - r.height / 2), 0) AS common, p.length * p.width * p.height + r.length * r.width * r.height AS volumes
      FROM preds p JOIN refs r USING (frame_id, instance_id) LEFT JOIN shared s ON s.frame_id = p.frame_id AND s.id = p.instance_id)"""


def _paired(spark, sf_dir) -> DataFrame:
    moved, refs = _shifted(spark, sf_dir)
    shape = ("center_x", "center_y", "center_z", "length", "width", "height", "yaw")
    p = moved.select("frame_id", F.col("instance_id").alias("id"), *[F.col(c).alias(f"p_{c}") for c in shape])
    q = refs.select("frame_id", F.col("instance_id").alias("id"), *[F.col(c).alias(f"r_{c}") for c in shape])
    return p.join(q, ["frame_id", "id"]).withColumn("_shared", overlap_area("p_", "r_"))


@query(f"WITH {_OBJ}, {_REFERENCE}, {_PREDICTED}, {_OVERLAP} SELECT frame_id, id, {r('bev', 4)} AS iou FROM iou")
def bev_iou_pairs(spark, sf_dir):
    return rounded(_paired(spark, sf_dir).select("frame_id", "id", bev_iou("p_", "r_", F.col("_shared")).alias("iou")), "iou", digits=4)


@query(f"WITH {_OBJ}, {_REFERENCE}, {_PREDICTED}, {_OVERLAP} SELECT frame_id, id, {r('common / (volumes - common)', 4)} AS iou FROM iou")
def iou_3d_pairs(spark, sf_dir):
    return rounded(_paired(spark, sf_dir).select("frame_id", "id", iou_3d("p_", "r_", F.col("_shared")).alias("iou")), "iou", digits=4)


def _outcomes(spark, sf_dir) -> DataFrame:
    moved, refs = _shifted(spark, sf_dir)
    return evaluation.outcomes(moved, refs, materialise(matching.match_boxes(matching.overlaps(moved, refs), 0.5), "matches"))


# objects are apart, so a prediction can only match its own reference
_OUTCOME = f"""matched AS (SELECT frame_id, id, bev FROM iou WHERE bev >= 0.5),
    results AS (
      SELECT 'tp' AS kind, m.frame_id, sqrt(r.center_x * r.center_x + r.center_y * r.center_y) AS distance, m.bev AS iou FROM matched m JOIN refs r ON r.frame_id = m.frame_id AND r.instance_id = m.id
      UNION ALL SELECT 'fp', p.frame_id, sqrt(p.center_x * p.center_x + p.center_y * p.center_y), NULL FROM preds p WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.frame_id = p.frame_id AND m.id = p.instance_id)
      UNION ALL SELECT 'fn', r.frame_id, sqrt(r.center_x * r.center_x + r.center_y * r.center_y), NULL FROM refs r WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.frame_id = r.frame_id AND m.id = r.instance_id))"""


@query(f"WITH {_OBJ}, {_REFERENCE}, {_PREDICTED}, {_OVERLAP}, {_OUTCOME} SELECT frame_id, id AS p_id, id AS r_id, {r('iou.bev', 4)} AS iou FROM matched AS iou")
def match_frames(spark, sf_dir):
    moved, refs = _shifted(spark, sf_dir)
    return rounded(matching.match_boxes(matching.overlaps(moved, refs), 0.5), "iou", digits=4)


_COUNTS = "count(*) FILTER (WHERE kind = 'tp') AS tp, count(*) FILTER (WHERE kind = 'fp') AS fp, count(*) FILTER (WHERE kind = 'fn') AS fn, coalesce(avg(iou), 0) AS mean_iou"
_RATIO = f"{r('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision, {r('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall, {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1, {r('mean_iou', 4)} AS mean_iou"
_MATCHED = f"WITH {_OBJ}, {_REFERENCE}, {_PREDICTED}, {_OVERLAP}, {_OUTCOME}"


@query(f"{_MATCHED}, c AS (SELECT {_COUNTS} FROM results) SELECT tp, fp, fn, {_RATIO} FROM c")
def detection_metrics(spark, sf_dir):
    return rounded(rounded(evaluation.metrics(_outcomes(spark, sf_dir)), "precision", "recall", "f1"), "mean_iou", digits=4)


@query(
    f"{_MATCHED}, bins(bin, name, low, high) AS (VALUES (0, '0-10m', 0, 10), (1, '10-20m', 10, 20), (2, '20-30m', 20, 30), (3, '30-40m', 30, 40), (4, '40-50m', 40, 50), (5, '50m+', 50, 1e308)), "
    f"c AS (SELECT bin, name, count(*) FILTER (WHERE kind = 'tp') AS tp, count(*) FILTER (WHERE kind = 'fp') AS fp, count(*) FILTER (WHERE kind = 'fn') AS fn, coalesce(avg(iou), 0) AS mean_iou FROM bins LEFT JOIN results ON distance >= low AND distance < high GROUP BY bin, name) "
    f"SELECT bin, name, tp, fp, fn, {_RATIO} FROM c"
)
def distance_metrics(spark, sf_dir):
    return rounded(rounded(evaluation.metrics_by_distance(_outcomes(spark, sf_dir)), "precision", "recall", "f1"), "mean_iou", digits=4)


@query(f"{_MATCHED} SELECT frame_id, tp, fp, fn, {r('mean_iou', 4)} AS mean_iou FROM (SELECT frame_id, {_COUNTS} FROM results GROUP BY frame_id)")
def frame_results(spark, sf_dir):
    return rounded(evaluation.frame_rows(_outcomes(spark, sf_dir)), "mean_iou", digits=4)


@query(f"{_MATCHED}, k AS (SELECT cast(unnest(range(0, 4)) AS int) AS bin) SELECT bin, count(kind) AS n FROM k LEFT JOIN results ON kind = 'tp' AND least(3, floor(iou * 4)) = bin GROUP BY bin")
def iou_histogram(spark, sf_dir):
    return evaluation.iou_histogram(_outcomes(spark, sf_dir))


@query("SELECT quality AS true_id, toxic AS pred_id, count(*) AS n FROM labels GROUP BY ALL")
def semantic_confusion(spark, sf_dir):
    return evaluation.confusion(spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("quality AS true_id", "toxic AS pred_id"))


@query(
    f"""WITH {_OBJ}, p AS (SELECT semantic_id AS t, CASE WHEN point_id % 5 = 0 THEN 50 ELSE semantic_id END AS q FROM obj), k AS (SELECT t AS class FROM p UNION SELECT q FROM p),
    s AS (SELECT class, count(*) FILTER (WHERE t = class AND q = class) AS tp, count(*) FILTER (WHERE t <> class AND q = class) AS fp, count(*) FILTER (WHERE t = class AND q <> class) AS fn FROM k, p WHERE t = class OR q = class GROUP BY class)
    SELECT cast(class AS int) AS class, tp, fp, fn, {r('tp / (tp + fp + fn)')} AS iou FROM s"""
)
def semantic_iou(spark, sf_dir):
    pairs = views.obj(spark, sf_dir).selectExpr("semantic_id AS true_id", "CASE WHEN point_id % 5 = 0 THEN 50 ELSE semantic_id END AS pred_id")
    return rounded(evaluation.semantic_iou(pairs), "iou")


# --- timing and data checks ----------------------------------------------------------------------

_SPREAD = f"{r('avg(d)', 3)} AS mean_ms, {r('stddev_pop(d)', 3)} AS std_ms, {', '.join(f'{r(f'quantile_cont(d, {p / 100})', 3)} AS p{p}_ms' for p in (50, 90, 99))}, {r('min(d)', 3)} AS min_ms, {r('max(d)', 3)} AS max_ms, {r('sum(d)', 3)} AS total_ms"
_MS = ("mean_ms", "std_ms", "p50_ms", "p90_ms", "p99_ms", "min_ms", "max_ms", "total_ms")


@query(f"WITH {_TIMING}, t AS (SELECT module, duration_ms AS d FROM timing) SELECT module, count(*) AS count, {_SPREAD}, {r('100 * sum(d) / (SELECT sum(d) FROM t)', 3)} AS percent FROM t GROUP BY module")
def perf_modules(spark, sf_dir):
    return rounded(timing.module_stats(views.timing(spark, sf_dir)), *_MS, "percent", digits=3)


@query(f"WITH {_TIMING}, t AS (SELECT frame_id, sum(duration_ms) AS d FROM timing GROUP BY frame_id) SELECT count(*) AS frames, {_SPREAD}, {', '.join(f'{r(f'1000 / {e}', 3)} AS fps_{n}' for n, e in (('mean', 'avg(d)'), ('p50', 'quantile_cont(d, 0.5)'), ('p90', 'quantile_cont(d, 0.9)'), ('p99', 'quantile_cont(d, 0.99)')))} FROM t")
def perf_frames(spark, sf_dir):
    return rounded(timing.frame_stats(views.timing(spark, sf_dir)), *_MS, "fps_mean", "fps_p50", "fps_p90", "fps_p99", digits=3)


@query(f"WITH {_TIMING} SELECT module, cast(sum(input_points) AS bigint) AS points, {r('sum(duration_ms)', 3)} AS total_ms, {r('sum(input_points) * 1000 / sum(duration_ms)', 3)} AS points_per_s FROM timing GROUP BY module")
def throughput(spark, sf_dir):
    return rounded(timing.throughput(views.timing(spark, sf_dir)), "total_ms", "points_per_s", digits=3)


@query(
    f"WITH {_OBJ}, p AS (SELECT frame_id, count(*) AS points FROM obj GROUP BY frame_id), l AS (SELECT frame_id, count(*) AS labels FROM obj WHERE NOT (frame_id % 3 = 1 AND point_id % 100 = 7) AND frame_id <> 2 GROUP BY frame_id) "
    "SELECT frame_id, points, coalesce(labels, 0) AS labels FROM p LEFT JOIN l USING (frame_id) WHERE points <> coalesce(labels, 0)"
)
def count_mismatch(spark, sf_dir):
    points = views.obj(spark, sf_dir)
    return quality.count_mismatch(points, points.where("NOT (frame_id % 3 = 1 AND point_id % 100 = 7) AND frame_id <> 2"))


@query(f"WITH {_OBJ} SELECT frame_id, 'invalid_label' AS failed FROM obj GROUP BY frame_id HAVING count(*) FILTER (WHERE semantic_id NOT IN {tuple(labels.NAMES)}) > 0")
def frame_checks(spark, sf_dir):
    return quality.frame_checks(views.obj(spark, sf_dir))


# ids move on from frame to frame, so that some instances have no successor
_MOVED = "instance_id + 3 * (frame_id % 7)"


@query(
    f"""WITH {_OBJ}, i AS (SELECT DISTINCT frame_id, {_MOVED} AS instance_id FROM obj WHERE instance_id <> 0 AND semantic_id IN {labels.THINGS}),
    f AS (SELECT frame_id, row_number() OVER (ORDER BY frame_id) - 1 AS pos, lead(frame_id) OVER (ORDER BY frame_id) AS after, count(*) OVER () AS n FROM (SELECT DISTINCT frame_id FROM obj)),
    k AS (SELECT unnest(range(0, 10)) AS k), s AS (SELECT DISTINCT frame_id, after FROM f, k WHERE after IS NOT NULL AND (n - 1 <= 10 OR pos = floor(k * (n - 2) / 9e0))),
    h AS (SELECT a.instance_id, b.instance_id AS hit FROM s JOIN i a ON a.frame_id = s.frame_id LEFT JOIN i b ON b.frame_id = s.after AND b.instance_id = a.instance_id)
    SELECT count(hit) AS shared, count(*) AS total, {r('count(hit) / count(*)')} AS rate, count(hit) / count(*) >= 0.5 AS passed FROM h"""
)
def instance_continuity(spark, sf_dir):
    return rounded(quality.instance_continuity(views.obj(spark, sf_dir).withColumn("instance_id", F.expr(_MOVED))), "rate")


@query("WITH m(ordinal, method, f1, mean_ms) AS (SELECT row_number() OVER (ORDER BY event_type), event_type, avg(value) / 1000, avg(value) FROM events GROUP BY event_type) SELECT (SELECT method FROM m ORDER BY f1 DESC, ordinal LIMIT 1) AS best_f1, (SELECT method FROM m ORDER BY mean_ms, ordinal LIMIT 1) AS fastest")
def ablation_best(spark, sf_dir):
    per = views.timing(spark, sf_dir).groupBy(F.col("module").alias("method")).agg(F.avg("duration_ms").alias("mean_ms"))
    return timing.best_methods(per.selectExpr("row_number() OVER (ORDER BY method) AS ordinal", "method", "mean_ms / 1000 AS f1", "mean_ms"))


# --- colours -------------------------------------------------------------------------------------

_T = "greatest(least((cast(z AS double) + 2) / 4, 1), 0)"


@query(f"WITH {_PTS}, t AS (SELECT frame_id, point_id, {_T} AS t FROM pts) SELECT frame_id, point_id, {r('CASE WHEN t < 0.5 THEN 0 ELSE 2 * (t - 0.5) END')} AS red, {r('CASE WHEN t < 0.25 THEN 4 * t WHEN t < 0.75 THEN 1 ELSE 4 * (1 - t) END')} AS green, {r('CASE WHEN t < 0.5 THEN 1 - 2 * t ELSE 0 END')} AS blue FROM t")
def height_color(spark, sf_dir):
    c = colors.by_height(F.col("z"))
    return rounded(views.pts(spark, sf_dir).select("frame_id", "point_id", *[x.alias(n) for x, n in zip(c, ("red", "green", "blue"), strict=True)]), "red", "green", "blue")


@query(
    f"WITH {_PTS}, t AS (SELECT frame_id, point_id, greatest(least(sqrt(cast(x AS double) * x + cast(y AS double) * y) / 50, 1), 0) AS t FROM pts) SELECT frame_id, point_id, "
    + ", ".join(f"{r(f'greatest(least({a} + {b} * t + {c} * t * t, 1), 0)')} AS {n}" for (a, b, c), n in zip(colors.RAMP, ("red", "green", "blue"), strict=True))
    + " FROM t"
)
def distance_color(spark, sf_dir):
    c = colors.by_distance(F.col("x"), F.col("y"))
    return rounded(views.pts(spark, sf_dir).select("frame_id", "point_id", *[x.alias(n) for x, n in zip(c, ("red", "green", "blue"), strict=True)]), "red", "green", "blue")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, voxels, and points and voxels by frame."""
    cropped = roi.crop(views.pts(spark, sf_dir), ROI)
    return voxel.voxel_fixed(cropped, 0.5).groupBy("frame_id").agg(F.sum("n").alias("points"), F.count("*").alias("voxels"))


from pointlake.plans import catalogue_more  # noqa: E402, F401  registers further queries, over what is defined above
