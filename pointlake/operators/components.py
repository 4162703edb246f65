"""Connected components by hooking to the least neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.session import WHOLE_ROWS, materialise


def connected_components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """``edges``: columns ``src``, ``dst`` of one orderable type; direction and repeats don't matter.

    Returns ``node``, ``component``: each node of an edge between two different nodes, with the
    least node it can reach. Rows with a null end and self-loops add nothing. An empty input gives
    an empty result.

    Each round every node hooks to its least neighbour, follows its parent ``jumps`` times, and the
    edges are contracted to parents. A local minimum has a neighbour that hooks away, so at least
    half of the nodes go each round and the rounds grow with the logarithm of the node count. All
    steps are aggregates with map-side combining and equi-joins that adaptive execution can split
    at hot keys; nothing is collected but one count a round, and while it is above ``WHOLE_ROWS``
    nothing is broadcast.
    """
    pair = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    live = materialise(pair.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    kind = live.schema["src"].dataType
    rounds: list[DataFrame] = []
    while n := live.count():
        met = (lambda df: df.hint("merge")) if n > WHOLE_ROWS else (lambda df: df)
        live = met(live)
        both = live.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(live.select("dst", "src"))
        hook = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent"))
        hook = met(materialise(hook, "hook"))
        up = hook
        for _ in range(jumps):
            above = hook.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            up = up.join(above, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"))
        up = met(materialise(up, "parents"))
        rounds.append(up)
        a = up.select(F.col("node").alias("src"), F.col("parent").alias("a"))
        b = up.select(F.col("node").alias("dst"), F.col("parent").alias("b"))
        moved = live.join(a, "src").join(b, "dst").where("a <> b")
        live = materialise(moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "edges")
    if not rounds:
        return live.select(F.col("src").alias("node"), F.col("src").cast(kind).alias("component"))
    label = rounds[0].withColumnRenamed("parent", "component")
    for up in rounds[1:]:
        label = label.join(up.select(F.col("node").alias("component"), F.col("parent").alias("next")), "component", "left")
        label = label.select("node", F.coalesce("next", "component").alias("component"))
    return label
