"""Command line over scan directories: run, eval, export, check, validate, ablate, view and all."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pointlake import logs
from pointlake.functions import labels
from pointlake.operators import quality, roi, timing
from pointlake.plans import config as configs
from pointlake.plans import detect, display, reports, workflow
from pointlake.session import materialise
from pointlake.sources import boxes as box_files
from pointlake.sources import scans

VERSION = "0.1.0"


VERBS = {
    "run": "detect boxes",
    "eval": "evaluate boxes",
    "export": "write point labels from boxes or from the labels themselves",
    "check": "check a sequence",
    "validate": "check written predictions",
    "ablate": "compare proposal methods",
    "view": "write what pictures show",
    "all": "check, run, eval and export, up to the first failure",
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="pointlake")
    out.add_argument("--version", action="version", version=VERSION)
    verbs = out.add_subparsers(dest="verb", required=True)
    for verb, text in VERBS.items():
        one = verbs.add_parser(verb, help=text)
        one.add_argument("--root", required=True, help="URI of the folder that holds sequences/")
        one.add_argument("--sequence", default="00")
        one.add_argument("--config")
        one.add_argument("--out", default="outputs")
        one.add_argument("--frames", help="a-b or n")
        one.add_argument("--log-level", default="WARNING")
        if verb in ("run", "all"):
            one.add_argument("--dry-run", action="store_true")
        if verb in ("export", "all"):
            one.add_argument("--what", choices=("boxes", "truth"), default="boxes")
        if verb == "all":
            one.add_argument("--skip", action="append", default=[], choices=("run", "eval", "export"))
    return out


def check(spark: SparkSession, root: str, name: str) -> int:
    """Prints what a sequence fails, 1 if anything: files first, and contents only where all files have whole sizes."""
    there = dict(quality.structure_checks(spark, root, name))
    bad = quality.file_checks(scans.scan_info(spark, root, name)).collect()
    if bad:
        for r in bad:
            print(f"frame {r['frame_id']}: {r['failed']}")
        print("contents not checked", file=sys.stderr)
        return 1
    if there["labels"]:
        points = scans.read_labelled(spark, root, name)
    else:
        points = scans.read_scans(spark, root, name).withColumns({c: F.lit(None).cast("int") for c in ("semantic_id", "instance_id")})
    labelled = points.where("semantic_id IS NOT NULL")
    problems = [f"frame {r['frame_id']}: {r['failed']}" for r in quality.frame_checks(points).orderBy("frame_id").collect()]
    problems += [f"label {r['semantic_id']}: unknown, {r['n']} points" for r in quality.invalid_labels(labelled).orderBy("semantic_id").collect()]
    found = quality.instance_continuity(labelled).first()
    if not found["passed"]:
        problems.append(f"instance continuity {found['rate']:.3f}: {found['shared']} of {found['total']}")
    for p in problems:
        print(p)
    return int(bool(problems))


def window(spark: SparkSession, given: argparse.Namespace, name: str, config: dict) -> tuple[int, int, int]:
    """start, end, step: --frames, else what the configuration says, of the frames there are."""
    last = scans.open_sequence(spark, given.root, name).agg(F.max("frame_id")).first()[0]
    if given.frames:
        return roi.parse_frame_range(given.frames, last + 1)
    return detect.frame_window(config, last + 1)


def _boxes(spark: SparkSession, given: argparse.Namespace, name: str):
    """The last record of each frame."""
    records = box_files.read_jsonl(spark, f"{given.out}/boxes/{name}/boxes.jsonl", "line_no")
    return box_files.flattened(box_files.one_record_per_frame(records)).withColumn("sequence", F.lit(name))


def _labelled(spark: SparkSession, given: argparse.Namespace, name: str, config: dict):
    """Labelled points of the frames that are asked for."""
    return roi.frame_range(scans.read_labelled(spark, given.root, name), *window(spark, given, name, config)).where("semantic_id IS NOT NULL")


def run(spark: SparkSession, given: argparse.Namespace, name: str, config: dict) -> int:
    start, end, step = window(spark, given, name, config)
    points = roi.frame_range(scans.read_scans(spark, given.root, name, start, end), start, end, step)
    path, clock = f"{given.out}/boxes/{name}", timing.Timings() if config.get("performance", {}).get("save_report") else None
    found = detect.detect(points, config, clock)
    box_files.write_jsonl(box_files.nested(found), f"{path}/boxes.jsonl")
    box_files.write_parquet(box_files.flattened(box_files.read_jsonl(spark, f"{path}/boxes.jsonl")), f"{path}/boxes.parquet")
    if clock:
        reports.write_performance(spark, clock.table(spark), f"{given.out}/reports", clock.records[0][3])
    return 0


def evaluate(spark: SparkSession, given: argparse.Namespace, name: str, config: dict) -> int:
    points, folder = _labelled(spark, given, name, config), f"{given.out}/reports"
    frames = points.select("frame_id").distinct().count()
    if not frames:
        print("no labelled frames", file=sys.stderr)
        return 1
    own = config.get("evaluation", {})
    if own.get("detection", True):
        results = materialise(detect.evaluate(points, _boxes(spark, given, name), config), "outcomes")
        print(reports.write_metrics(spark, results, config, frames, folder))
        reports.write_charts(spark, results, config, f"{folder}/figures")
    if own.get("official", False):
        predicted = scans.unpacked(scans.read_raw_labels(spark, given.out, name, "predictions")).select("sequence", "frame_id", "point_id", F.col("semantic_id").alias("pred"))
        both = points.join(predicted, ["sequence", "frame_id", "point_id"])
        pairs = both.select(labels.canonical(F.col("semantic_id")).alias("true_id"), labels.canonical(F.col("pred")).alias("pred_id"), "x", "y")
        targets = [labels.NAMES[i] for i in sorted(detect.target_ids(config)) if i in labels.NAMES and i not in labels.CANONICAL]
        reports.write_semantic(spark, materialise(pairs, "pairs"), labels.NAMES, targets, folder)
    return 0


def export(spark: SparkSession, given: argparse.Namespace, name: str, config: dict) -> int:
    start, end, step = window(spark, given, name, config)
    if given.what == "truth":
        labelled = _labelled(spark, given, name, config).select("sequence", "frame_id", "point_id", "semantic_id", "instance_id")
    else:
        labelled = detect.point_labels(roi.frame_range(scans.read_scans(spark, given.root, name, start, end), start, end, step), _boxes(spark, given, name))
    done = materialise(scans.write_labels(labelled, given.out), "exported")
    wanted = scans.scan_info(spark, given.root, name).where(F.col("frame_id").between(start, end - 1) & ((F.col("frame_id") - start) % step == 0))
    totals = scans.export_totals(wanted, done).first()
    print(f"{totals['exported']} of {totals['frames']} frames, {totals['points']} points")
    for r in scans.export_failures(wanted, done).orderBy("frame_id").limit(10).collect():  # the first ten are shown
        print(f"frame {r['frame_id']}: {r['error']}", file=sys.stderr)
    return int(totals["failed"] > 0)


def validate(spark: SparkSession, given: argparse.Namespace, name: str, config: dict) -> int:
    """Predictions of the named sequence, or of all sequences below --out if --sequence is "all"."""
    names, bad = (scans.sequences_with_predictions(spark, given.out) if given.sequence == "all" else [name]), 0
    for one in names:
        expected = scans.open_sequence(spark, given.root, one)
        problems = quality.prediction_checks(expected, scans.prediction_files(spark, given.out, one))
        for r in problems.orderBy("frame_id").collect():
            bad = 1
            print(f"{one} frame {r['frame_id']}: {r['problem']}")
    return bad


def ablate(spark: SparkSession, given: argparse.Namespace, name: str, config: dict) -> int:
    methods = detect.proposal_methods(config)
    points = materialise(_labelled(spark, given, name, config), "points")
    if points.isEmpty():
        print("no labelled frames", file=sys.stderr)
        return 1
    print(reports.ablation_markdown(reports.write_ablation(spark, detect.ablate(points, config, methods), f"{given.out}/reports")))
    return 0


def view(spark: SparkSession, given: argparse.Namespace, name: str, config: dict) -> int:
    """Parquet of points with colours, box edges and, with labels, the overlay, below out/view."""
    start, end, step = window(spark, given, name, config)
    folder, boxes = f"{given.out}/view/{name}", _boxes(spark, given, name)
    display.stage_points(roi.frame_range(scans.read_scans(spark, given.root, name, start, end), start, end, step), config).write.mode("overwrite").parquet(f"{folder}/points")
    shown = display.in_display(roi.frame_range(boxes, start, end, step).where("valid"), display.display_bounds(config))
    display.box_edges(shown).write.mode("overwrite").parquet(f"{folder}/edges")
    points = _labelled(spark, given, name, config)
    if not points.isEmpty():
        display.overlay(points, boxes, config).write.mode("overwrite").parquet(f"{folder}/overlay")
    return 0


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    logs.setup(given.log_level)
    config = configs.load(path=given.config) if given.config else {}
    if getattr(given, "dry_run", False):
        print(detect.explain(config))
        return 0
    spark = SparkSession.builder.appName("pointlake").getOrCreate()
    name = scans.sequence_name(given.sequence)
    verbs = {"run": run, "eval": evaluate, "export": export, "validate": validate, "ablate": ablate, "view": view}
    if given.verb == "check":
        return check(spark, given.root, name)
    if given.verb != "all":
        return verbs[given.verb](spark, given, name, config)
    steps = [("check", lambda: check(spark, given.root, name)), *((v, lambda v=v: verbs[v](spark, given, name, config)) for v in ("run", "eval", "export"))]
    code, done = workflow.run(steps, given.skip)
    print(f"done: {', '.join(done) or 'nothing'}")
    return code


if __name__ == "__main__":
    sys.exit(main())
