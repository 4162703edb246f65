"""Report files: metrics, performance, ablation and chart data, written to any store that the engine knows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from pointlake.operators import evaluation, timing
from pointlake.session import write_text


def write_metrics(spark: SparkSession, results: DataFrame, config: dict, num_frames: int, folder: str) -> str:
    """det_metrics.json in ``folder``; returns its text. ``results``: outcome rows, read three times."""
    own = config.get("evaluation", {})
    edges = evaluation.distance_edges(own.get("distance_bins") or evaluation.DISTANCE_EDGES)
    said = {"iou_threshold": float(own.get("iou_threshold", 0.5)), "use_3d_iou": bool(own.get("use_3d_iou", False)), "match_classes": True, "distance_bins": edges, "reference_boxes": "oriented boxes of visible labelled points of at least 10 points; no benchmark AP"}
    text = evaluation.metrics_json(evaluation.metrics(results), evaluation.metrics_by_distance(results, edges), said, num_frames)
    write_text(spark, f"{folder}/det_metrics.json", text)
    return text


def write_charts(spark: SparkSession, results: DataFrame, config: dict, folder: str) -> list[str]:
    """F1 by distance and the histogram of matched overlaps: f1_by_distance.csv and iou_histogram.csv, and PNG files of the same where matplotlib is there."""
    edges = evaluation.distance_edges(config.get("evaluation", {}).get("distance_bins") or evaluation.DISTANCE_EDGES)
    bars = {
        "f1_by_distance": [(r["name"], r["f1"]) for r in evaluation.metrics_by_distance(results, edges).orderBy("bin").collect()],
        "iou_histogram": [(("0-0.25", "0.25-0.5", "0.5-0.75", "0.75-1")[r["bin"]], r["n"]) for r in evaluation.iou_histogram(results).orderBy("bin").collect()],
    }
    for name, rows in bars.items():
        write_text(spark, f"{folder}/{name}.csv", "\n".join(["name,value", *(f"{a},{b}" for a, b in rows), ""]))
    try:
        from matplotlib.figure import Figure
    except ImportError:
        return [f"{n}.csv" for n in bars]
    import io

    from pointlake.session import write_bytes

    for name, rows in bars.items():
        figure = Figure(figsize=(8, 5))
        axes = figure.subplots()
        axes.bar([a for a, _ in rows], [b for _, b in rows])
        axes.set_title(name.replace("_", " "))
        held = io.BytesIO()
        figure.savefig(held, format="png", dpi=150)
        write_bytes(spark, f"{folder}/{name}.png", held.getvalue())
    return [f"{n}.{x}" for n in bars for x in ("csv", "png")]


def write_performance(spark: SparkSession, records: DataFrame, folder: str, total_points: int = 0) -> dict:
    """perf.json and perf.md in ``folder``; returns the report."""
    body = timing.report(records, total_points)
    write_text(spark, f"{folder}/perf.json", timing.report_json(body))
    write_text(spark, f"{folder}/perf.md", timing.report_markdown(body))
    return body


def ablation_markdown(rows: list[dict]) -> str:
    """A table of the methods and which is best: the highest F1 and the least time a frame, the first on ties."""
    lines = ["# Ablation of proposal methods", "", "Against oriented boxes of visible labelled points; not a benchmark's AP.", "", "| method | precision | recall | F1 | mean IoU | proposals a frame | ms a frame |", "| --- |" + " ---: |" * 6]
    lines += [f"| {r['method']} | {r['precision']:.3f} | {r['recall']:.3f} | {r['f1']:.3f} | {r['mean_iou']:.3f} | {r['num_proposals']:.1f} | {r['mean_ms']:.1f} |" for r in rows]
    best, fast = max(rows, key=lambda r: r["f1"]), min(rows, key=lambda r: r["mean_ms"])
    return "\n".join([*lines, "", f"Highest F1: {best['method']} ({best['f1']:.3f}).", f"Least time: {fast['method']} ({fast['mean_ms']:.1f} ms a frame).", ""])


def write_ablation(spark: SparkSession, results: DataFrame, folder: str) -> list[dict]:
    """ablation_proposals.json and .md in ``folder`` from ``detect.ablate``; returns its rows, one a method."""
    rows = [r.asDict() for r in results.orderBy("ordinal").collect()]
    if not rows:
        raise ValueError("an ablation needs at least one method")
    write_text(spark, f"{folder}/ablation_proposals.json", json.dumps({"results": rows}, allow_nan=False, indent=2))
    write_text(spark, f"{folder}/ablation_proposals.md", ablation_markdown(rows))
    return rows


def write_semantic(spark: SparkSession, pairs: DataFrame, names: dict[int, str], targets: list[str], folder: str) -> dict:
    """semantic_metrics.json: per-class IoU, mean IoU and accuracy overall and by distance bin, and the mean over the target classes.

    ``pairs``: true_id, pred_id (canonical classes), x, y.
    """
    per_class = evaluation.semantic_iou(pairs).collect()
    whole = evaluation.semantic_summary(pairs).first()
    binned = evaluation.with_distance_bin(pairs)
    found = {names.get(r["class"], f"unknown-{r['class']}"): r["iou"] for r in per_class}
    chosen = [found[t] for t in targets if t in found]
    body = {
        "per_class_iou": found,
        "mean_iou": whole["mean_iou"],
        "accuracy": whole["accuracy"],
        "by_distance": {r["bin"]: {"mean_iou": r["mean_iou"], "accuracy": r["accuracy"], "classes": r["classes"]} for r in evaluation.semantic_summary(binned, ["bin"]).collect()},
        "targets": {"mean_iou": sum(chosen) / len(chosen) if chosen else None, "missing": [t for t in targets if t not in found]},
    }
    write_text(spark, f"{folder}/semantic_metrics.json", json.dumps(body, allow_nan=False, indent=2))
    return body
