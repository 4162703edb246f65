"""The command line over small scan folders: frames, unlabelled frames, reports, exports and the workflow."""

import json
import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake import cli, logs, session
from pointlake.functions import colors, labels
from pointlake.operators import timing
from pointlake.plans import detect, display, reports, workflow
from pointlake.sources import boxes as box_files
from pointlake.sources import scans

CAR, FRAMES = 10, 3
CONFIG = """
preprocess: {voxel: {enabled: false}}
ground: {z_max: -1.0, num_iterations: 60}
proposals: {method: dbscan, dbscan: {mode: fixed, eps: 0.9, min_points: 3}}
boxes: {max_box_volume: 100}
dbscan_fixed: {mode: fixed, eps: 0.9, min_points: 3}
bev_cc: {resolution: 1.0, min_height: 0.3, min_points: 3}
ablation: {methods: [{name: bev_cc}, {name: dbscan_fixed}]}
evaluation: {targets: {car: true}, distance_bins: [0, 10, 20], official: %s}
performance: {save_report: true}
"""


def car(x, y):
    """Points on a grid of 4 x 2 x 1.5 metres."""
    g = np.stack(np.meshgrid(np.linspace(-2, 2, 6), np.linspace(-1, 1, 4), np.linspace(-0.6, 0.9, 4), indexing="ij"), -1).reshape(-1, 3)
    return g + (x, y, 0.5)


@pytest.fixture
def root(tmp_path):
    """Three frames with two cars each and a floor; the last frame has no labels."""
    folder = tmp_path / "data" / "sequences" / "00"
    (folder / "velodyne").mkdir(parents=True)
    (folder / "labels").mkdir()
    for k in range(FRAMES):
        floor = np.stack(np.meshgrid(np.arange(0, 40, 2.0), np.arange(-20, 20, 4.0), [-1.5], indexing="ij"), -1).reshape(-1, 3)
        parts = [car(8 + k, 0), car(25, 6), floor]
        points = np.zeros((sum(map(len, parts)), 4), "<f4")
        points[:, :3] = np.concatenate(parts)
        points.tofile(folder / "velodyne" / f"{k:06d}.bin")
        if k < FRAMES - 1:
            raw = np.concatenate([np.full(len(p), v, "<u4") for p, v in zip(parts, (CAR | 1 << 16, CAR | 2 << 16, 40), strict=True)])
            raw.tofile(folder / "labels" / f"{k:06d}.label")
    (tmp_path / "c.yaml").write_text(CONFIG % "false")
    (tmp_path / "official.yaml").write_text(CONFIG % "true")
    return tmp_path


def call(root, verb, *more, config="c.yaml"):
    return cli.main([verb, "--root", f"file://{root}/data", "--out", f"file://{root}/out", "--config", str(root / config), *more])


def test_run_eval_export_and_validate(spark, root, capsys):
    assert call(root, "run") == 0
    perf = timing.load_report(spark, f"file://{root}/out/reports/perf.json")
    assert {m["module"] for m in perf["modules"]} == {"roi_crop", "voxel", "ground", "proposals", "filtering", "boxes"} and perf["summary"]["total_points"] > 0
    assert "| boxes |" in (root / "out/reports/perf.md").read_text()
    assert call(root, "eval") == 0
    body = json.loads((root / "out/reports/det_metrics.json").read_text())
    # frame 2 has boxes and no labels: it is not evaluated, so its boxes are no false alarms
    assert body["num_frames"] == 2 and (body["overall"]["tp"], body["overall"]["fp"], body["overall"]["fn"]) == (4, 0, 0)
    assert list(body["by_distance"]) == ["0-10m", "10-20m", "20m+"] and body["config"]["distance_bins"] == [0.0, 10.0, 20.0, "inf"]
    assert sum(b["predictions"] for b in body["by_distance"].values()) == body["overall"]["predictions"] == 4
    assert (root / "out/reports/figures/f1_by_distance.csv").read_text().startswith("name,value\n0-10m,1.0")
    assert call(root, "eval", "--frames", "0-1") == 0 and json.loads((root / "out/reports/det_metrics.json").read_text())["num_frames"] == 1
    assert call(root, "eval", "--frames", "2") == 1  # no labelled frame
    assert call(root, "export", "--frames", "0-2", "--what", "truth") == 0
    for k in range(2):
        assert (root / f"out/sequences/00/predictions/{k:06d}.label").read_bytes() == (root / f"data/sequences/00/labels/{k:06d}.label").read_bytes()
    capsys.readouterr()
    assert call(root, "validate") == 1 and "00 frame 2: missing" in capsys.readouterr().out
    assert call(root, "export", "--what", "truth") == 1  # frame 2 has no labels
    said = capsys.readouterr()
    assert "2 of 3 frames" in said.out and "frame 2: no labels" in said.err
    assert call(root, "export") == 0 and call(root, "validate", "--sequence", "all") == 0
    assert call(root, "eval", config="official.yaml") == 0
    found = json.loads((root / "out/reports/semantic_metrics.json").read_text())
    assert found["per_class_iou"]["car"] == 1.0 and found["targets"] == {"mean_iou": 1.0, "missing": []} and set(found["by_distance"]) == {"0-10m", "10-20m", "20-30m", "30-40m", "40-50m"} - {"40-50m"} | ({"40-50m"} & set(found["by_distance"]))
    assert call(root, "view") == 0
    shown = spark.read.parquet(f"file://{root}/out/view/00/overlay")
    assert {(r.frame_id, r.tp, r.fp, r.fn) for r in display.overlay_counts(shown).collect()} == {(0, 2, 0, 0), (1, 2, 0, 0)}
    assert spark.read.parquet(f"file://{root}/out/view/00/edges").count() == 12 * 6


def test_ablation_report(spark, root, capsys):
    assert call(root, "ablate") == 0
    rows = json.loads((root / "out/reports/ablation_proposals.json").read_text())["results"]
    assert [r["method"] for r in rows] == ["bev_cc", "dbscan_fixed"] and all(r["f1"] == 1.0 and r["mean_ms"] > 0 and r["num_proposals"] == 2 for r in rows)
    text = (root / "out/reports/ablation_proposals.md").read_text()
    assert "Highest F1: bev_cc (1.000)" in text and "not a benchmark's AP" in text and "Least time:" in text
    with pytest.raises(ValueError, match="at least one"):
        detect.proposal_methods({})


def test_all_stops_at_the_first_failure(spark, root, capsys, monkeypatch):
    (root / "data/sequences/00/velodyne/000001.bin").write_bytes(b"123")
    assert call(root, "all") == 1
    assert "done: nothing" in capsys.readouterr().out and not (root / "out").exists()
    ran = []
    step = lambda name, code=0: (name, lambda: ran.append(name) or code)
    assert workflow.run([step("a"), step("b", 1), step("c")]) == (1, ["a"]) and ran == ["a", "b"]
    assert workflow.run([step("a"), ("x", lambda: 1 / 0), step("c")]) == (1, ["a"])
    assert workflow.run([step("a"), step("b"), step("c")], skip=["b"]) == (0, ["a", "c"])


def test_frame_windows():
    assert detect.frame_window({}, 9) == (0, 9, 1)
    assert detect.frame_window({"frames": {"start": 2, "end": 50, "step": 3}}, 9) == (2, 9, 3)
    assert detect.frame_window({"dataset": {"frame_range": {"start": 0, "end": 5, "step": 5}}}, 9) == (0, 5, 5)
    for own in ({"start": -1}, {"start": 9}, {"start": 3, "end": 3}, {"step": 0}):
        with pytest.raises(ValueError):
            detect.frame_window({"frames": own}, 9)


def test_missing_sequences_and_frames(spark, root):
    with pytest.raises(FileNotFoundError):
        scans.open_sequence(spark, f"file://{root}/data", 7)
    with pytest.raises(IndexError):
        scans.read_frame(spark, f"file://{root}/data", 0, 3)
    assert scans.read_frame(spark, f"file://{root}/data", 0, 1).select("frame_id").distinct().collect() == [(1,)]
    assert scans.prediction_files(spark, f"file://{root}/none", 0).count() == 0 and scans.sequences_with_predictions(spark, f"file://{root}/none") == []


def test_records_of_a_frame_by_their_place_in_the_file(spark, tmp_path):
    line = lambda frame, n: json.dumps({"frame_id": frame, "num_boxes": n, "num_valid_boxes": 0, "boxes": []})
    (tmp_path / "b.jsonl").write_text("\n".join([line(1, 1), line(2, 1), "", line(1, 2), line(-4, 1), line(1, 3)]))
    rows = box_files.read_jsonl(spark, f"file://{tmp_path}/b.jsonl", "line_no")
    pick = lambda last: sorted((r.frame_id, r.num_boxes) for r in box_files.one_record_per_frame(rows, last=last).collect())
    assert pick(True) == [(1, 3), (2, 1)] and pick(False) == [(1, 1), (2, 1)]


def test_boxes_in_the_display_region(spark):
    config = {"preprocess": {"roi": {"x_max": 60}}, "visualization": {"display_roi": {"x_min": 0, "x_max": 35, "y_min": -12, "y_max": 12}}}
    bounds = display.display_bounds(config)
    assert (bounds.x_max, bounds.y_min, bounds.z_min) == (35.0, -12.0, -3.0) and display.display_bounds({"preprocess": config["preprocess"]}).x_max == 60.0
    boxes = spark.createDataFrame([(0, 10.0, 0.0), (1, 35.0, 12.0), (2, 36.0, 0.0), (3, 10.0, -13.0)], "box_id int, center_x double, center_y double")
    assert sorted(r.box_id for r in display.in_display(boxes, bounds).collect()) == [0, 1]


def test_ontology_files(spark, tmp_path):
    (tmp_path / "o.yaml").write_text("labels: {0: none, 10: car, 40: road}\ncolor_map: {10: [1, 2, 3]}\nlearning_map: {10: 1, 40: 9}\nsplit: {train: [0]}\n")
    tables = labels.load_ontology(str(tmp_path / "o.yaml"))
    rows = {r.semantic_id: r for r in labels.ontology_dimension(spark, tables).collect()}
    assert (rows[10].name, rows[10].training_id, rows[10].thing, rows[10].blue, rows[40].thing) == ("car", 1, True, 1, False) and tables["content"] == {}
    (tmp_path / "bad.yaml").write_text("[1]")
    with pytest.raises(ValueError):
        labels.load_ontology(str(tmp_path / "bad.yaml"))
    assert labels.split_sequences("valid") == (8,)


def test_instance_and_cluster_colours(spark):
    points = spark.createDataFrame([(0, 5), (0, 9), (0, 9), (0, 0), (1, 9)], "frame_id int, instance_id int")
    got = {(r.frame_id, r.instance_id): tuple(r.color) for r in colors.by_instance(points).collect()}
    assert got[0, 5] == pytest.approx(colors.palette(2)[0]) and got[0, 9] == pytest.approx(colors.palette(2)[1]) and got[0, 0] == colors.GREY and got[1, 9] == pytest.approx(colors.palette(1)[0])
    rows = spark.createDataFrame([(0,), (2,), (-1,), (None,)], "c int").select("c", colors.by_cluster(F.col("c"), 3).alias("v")).collect()
    assert tuple(rows[1].v) == pytest.approx(colors.palette(3)[2]) and tuple(rows[2].v) == tuple(rows[3].v) == colors.GREY
    assert colors.palette(0) == [] and len(set(colors.palette(40))) == 40


def test_logging(tmp_path, capsys):
    logs.setup("INFO", str(tmp_path / "run.log"))
    logs.get("x", frame=3).bound(step="boxes").info("made %d", 4)
    assert "INFO pointlake.x: [frame=3 step=boxes] made 4" in (tmp_path / "run.log").read_text() and "made 4" in capsys.readouterr().err
    logs.setup("WARNING")
    assert len(logging.getLogger("pointlake").handlers) == 1


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="shared? folder|share"):
        session.shared_dir(Session())


def test_reports_of_nothing(spark):
    body = timing.report(timing.Timings().table(spark))
    assert body["frame_timing"] is None and body["summary"]["total_frames"] == 0 and timing.report_markdown(body).startswith("# Performance")
    with pytest.raises(ValueError):
        reports.write_ablation(spark, spark.createDataFrame([], "ordinal int, method string"), "file:///nowhere")
