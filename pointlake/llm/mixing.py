"""Mixing sources to target weights by capped water-filling.

Sources share the mix in proportion to their weights, but none gives more than ``max_epochs`` times
its words: such sources are clamped there and the excess is shared again among the others, until no
share is above its clamp. A source's share in words then becomes whole repetitions of all its
documents and one fractional repetition: documents in a seeded random order until the share is
reached, the last one in part.

The order is by hash, so a document's part follows from one cut per source. The cut is found by
narrowing: words are summed per source and hash prefix (at most 4,096 a source), then within the
prefix that holds the cut, and so on; only the rows of the last prefix are ever ordered. A source
with a third of all documents costs no task more than any other: rows meet what is known of their
source in a broadcast join if sources are few by count, else in a join by source and a part of the
order hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlake.llm.text import fresh, named, word_count
from pointlake.operators.partitioning import cut_points, deal, range_index
from pointlake.session import materialise, shuffle_partitions

#: Bits of the order hash, and bits of it that one narrowing looks at.
HASH_BITS, STEP_BITS = 60, 12
#: Up to so many sources (a few numbers each) are broadcast; beyond, each meets its rows in so many parts.
FEW, SALTS = 20_000, 32


def order_hash(doc_id: Column, text: Column, seed: int) -> Column:
    """60 bits of the MD5 of seed, id and text: where a document stands in its source's order."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("long")


def _source_key(source: Column) -> Column:
    """Sorts by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank``, 0-based in key order, by ranges: rows of a range are numbered in one task, ranges by a prefix sum over one row each."""
    spark = sources.sparkSession
    n = shuffle_partitions(spark)
    index = F.lit(0)
    count = sources.count()
    if count > 10_000:  # few sources make one range
        lead = F.conv(F.rpad(F.substring(F.hex("key"), 1, 14), 14, "0"), 16, 10).cast("long")  # the first seven bytes
        index = range_index(lead, cut_points(sources.select(lead.alias("lead")), "lead", n))
    parts = materialise(deal(sources.withColumn("range", index.cast("int")), index, n).drop("slot"), "sources")
    bases, at = {}, 0
    for r in sorted(parts.groupBy("range").count().collect()):
        bases[r[0]] = at
        at += r[1]
    base = F.element_at(F.array(*[F.lit(bases.get(i, 0)) for i in range(max(bases, default=0) + 1)]), F.col("range") + 1)
    inside = F.row_number().over(Window.partitionBy("range").orderBy("key")) - 1
    return parts.withColumn("rank", (base + inside).cast("long")).drop("range")


def _meet(rows: DataFrame, sources: DataFrame, key: str = "key", order: str = "order") -> DataFrame:
    """Rows with what ``sources``, written and one row a key, says of their key."""
    if sources.count() <= FEW:
        return rows.join(F.broadcast(sources), key)
    salt = fresh("salt", [*rows.columns, *sources.columns])
    parts = sources.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(order, F.lit(SALTS)).cast("int")).join(parts, [key, salt]).drop(salt)


def targets(sized: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """key, source_size, weight, target of each source of ``sized`` (key, size).

    Weights go to the sources in key order, repeating. A share is weight * (all words - clamped
    words) / weights of unclamped sources, in one division of whole numbers. Each round clamps every
    source whose share is above ``max_epochs`` times its words; what is carried between rounds is
    four numbers. If every source is clamped the mix is smaller than all words.
    """
    sources = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    ranked = _ranked(sources)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).cast("long")
    table = materialise(ranked.select("key", "source_size", weight.alias("weight")), "weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    clamp, free_weight, clamped_words = F.lit(False), None, 0
    while True:
        got = table.withColumn("clamped", clamp).groupBy("clamped").agg(F.sum("weight").alias("w"), F.sum("source_size").alias("s")).collect()
        now = {r["clamped"]: r for r in got}
        w, s = (now[False]["w"] if False in now else 0), (now[True]["s"] if True in now else 0)
        if (w, s) == (free_weight, clamped_words):
            break
        free_weight, clamped_words = w, s
        left = total - max_epochs * clamped_words
        # weight * left / free_weight > max_epochs * size, without rounding
        clamp = (F.col("weight").cast("decimal(38,0)") * F.lit(left) > F.col("source_size").cast("decimal(28,0)") * F.lit(max_epochs * (free_weight or 0))) if free_weight else F.lit(True)
        if free_weight == 0:
            break
    left = total - max_epochs * clamped_words
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(free_weight or 1))
    return table.select("key", "source_size", "weight", F.when(clamp, (F.col("source_size") * max_epochs).cast("double")).otherwise(share).alias("target"))


def cuts(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """For each source of ``plan``: key, source_size, target, whole (repetitions of all documents), cut and part, written.

    Documents whose order hash is below ``cut`` are repeated once more; those at it give ``part``
    words each.
    """
    goal = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    need = plan.select("key", "source_size", "target", whole.alias("whole"), (goal - whole * F.col("source_size")).alias("need"), F.lit(0).cast("long").alias("prefix"))
    rows = sized.select("key", "size", "order")
    need = materialise(need, "needs")
    open_ = need.where("need > 0")
    for depth in (1, 2):
        shift = HASH_BITS - STEP_BITS * depth
        narrowed = rows if depth == 1 else _meet(rows, open_.select("key", F.col("prefix").alias("up"))).where(F.shiftright("order", shift + STEP_BITS) == F.col("up")).drop("up")
        sums = narrowed.groupBy("key", F.shiftright("order", shift).alias("at")).agg(F.sum("size").alias("words"))
        sums = sums.join(open_.select("key", "need"), "key")
        running = F.sum("words").over(Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
        cut = sums.withColumn("upto", running).where("upto >= need AND upto - words < need")
        open_ = materialise(cut.select("key", F.col("at").alias("prefix"), (F.col("need") - F.col("upto") + F.col("words")).alias("need")), "cut")
    last = _meet(rows, open_).where(F.shiftright("order", HASH_BITS - 2 * STEP_BITS) == F.col("prefix"))
    ties = last.groupBy("key", "order").agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.first("need").alias("need"))
    running = F.sum("words").over(Window.partitionBy("key").orderBy("order").rowsBetween(Window.unboundedPreceding, 0))
    edge = ties.withColumn("upto", running).where("upto >= need AND upto - words < need")
    edge = edge.select("key", F.col("order").alias("cut"), F.expr("(need - upto + words) div rows").alias("part"))
    # need = 0: a cut below every hash
    out = need.drop("prefix", "need").join(edge, "key", "left").select("key", "source_size", "target", "whole", F.coalesce("cut", F.lit(-1)).alias("cut"), F.coalesce("part", F.lit(0)).cast("long").alias("part"))
    return materialise(out, "plan")


def _extra() -> Column:
    return F.when(F.col("order") < F.col("cut"), F.col("size")).when(F.col("order") == F.col("cut"), F.col("part")).otherwise(F.lit(0))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), whole, extra of every row.

    Sizes are in words; null and empty texts have none and give none. A null source is a source, the
    last in order. Repeated rows stand at the same place of the order and share its words evenly.
    Sources without words have target 0. Other columns are not read; an empty table gives no rows.
    The order depends on seed, id and text alone, so reruns agree.
    """
    sized = docs.select(F.col("doc_id").cast("long"), _source_key(F.col("source")).alias("key"), word_count(F.col("text")).alias("size"), order_hash(F.col("doc_id"), F.col("text"), seed).alias("order"))
    sized = materialise(sized, "sizes")
    plan = cuts(sized, targets(sized, weights, max_epochs))
    got = _meet(sized, plan)
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("whole") + _extra()).cast("long").alias("taken"), F.col("whole"), _extra().cast("long").alias("extra"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """The documents of the mix, all columns of ``docs``: each row as often as it is repeated, and once more for its part.

    A part is the text up to the end of its last word taken. ``n_chars``, if there, follows the text.
    Null and empty texts give no words and come as often as whole repetitions of their source; a null
    source is a source, the last in order; repeated rows share their place of the order evenly.
    Columns may have any names. An empty table gives no rows.
    """
    source, order_of, size = _source_key(F.col("source")), order_hash(F.col("doc_id"), F.col("text"), seed), word_count(F.col("text"))
    sized = materialise(docs.select(source.alias("key"), size.alias("size"), order_of.alias("order")), "sizes")
    key, whole, cut, part, order, take = (fresh(c, docs.columns) for c in ("key", "whole", "cut", "part", "order", "take"))
    plan = cuts(sized, targets(sized, weights, max_epochs)).select(F.col("key").alias(key), F.col("whole").alias(whole), F.col("cut").alias(cut), F.col("part").alias(part))
    rows = _meet(docs.withColumn(order, order_of).withColumn(key, source), plan, key, order)
    more = F.when(F.col(order) < F.col(cut), -1).when((F.col(order) == F.col(cut)) & (F.col(part) > 0), F.col(part)).otherwise(0)
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col(whole).cast("int")), F.when(more != 0, F.array(more.cast("long"))).otherwise(F.array().cast("array<long>")))
    taken = rows.withColumn(take, F.explode(copies))
    text = F.when(F.col(take) < 0, F.col("text")).otherwise(first_words(F.col("text"), F.greatest(F.col(take), F.lit(0)).cast("int")))
    out = taken.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*named(docs))


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its n-th word."""
    lead = F.regexp_extract(text, r"^[\x20\x09-\x0D]*", 0)
    runs = F.split(F.substring(text, F.length(lead) + 1, F.length(text)), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.concat(lead, F.array_join(F.slice(runs, F.lit(1), n), ""))
