"""Quality rules as a bitmask ledger, in DataFrame functions alone.

Each rule is evaluated once per document. The ledger keeps the measurements and one bit a rule that
failed; what is kept then follows from a policy, a named and versioned mask of the rules that count.
Changing a policy, or asking what a rule alone removes, reads the ledger and not the texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.llm.text import words_column

#: Bit -> (name, failing condition over the measurements). Bits are never reused.
RULES: dict[int, tuple[str, str]] = {
    0: ("few_words", "n_words < 20"),
    1: ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    2: ("symbols", "10 * n_symbols > 3 * n_words"),
    3: ("duplicate_lines", "n_dup_lines > 3 AND 10 * n_dup_lines > 3 * n_lines"),
    4: ("short_words", "word_chars < 2 * n_words"),
    5: ("long_words", "word_chars > 20 * n_words"),
    6: ("capitals", "10 * n_capitals > 4 * word_chars"),
    7: ("shouting", "10 * n_shouts > 3 * n_words"),
    8: ("no_letters", "10 * n_letter_words < 6 * n_words"),
    9: ("very_long", "n_words > 1000000"),
    10: ("stutter", "10 * n_stutters > 3 * n_words"),
}


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[int, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r for r in self.rules)


#: Versions stay as they were published.
POLICIES = {
    ("base", 1): Policy("base", 1, (0, 1)),
    ("web", 1): Policy("web", 1, (0, 1, 2, 3, 4, 5, 6, 7, 8, 10)),
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, although ``use`` names it several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pairs(items: Column, step: int, combine: Callable[[Column, Column], Column]) -> Column:
    """combine(items[i], items[i + step]) for all i that have both."""
    n = F.greatest(F.size(items) - step, F.lit(0))
    return F.zip_with(F.slice(items, F.lit(1), n), F.slice(items, F.lit(1 + step), n), combine)


def _window_hashes(words: Column) -> Column:
    """64-bit hashes of every 8 consecutive words: of 2, then 4, then 8."""
    out = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        out = _let(out, lambda h: _pairs(h, step, lambda a, b: F.xxhash64(a, b)))
    return out


def _repeat_words(windows: Column) -> Column:
    """Words in windows of 8 that occur twice or more, from the window hashes: sorted with their places, equal neighbours found, covered words summed over ascending places."""
    none = F.array().cast("array<int>")

    def places(ranked: Column) -> Column:
        equal = _pairs(ranked, 1, lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(none))
        return F.sort_array(F.array_distinct(F.flatten(equal)))

    def covered(at: Column) -> Column:
        gaps = _pairs(at, 1, lambda a, b: F.least(b - a, F.lit(8)))
        return F.aggregate(gaps, F.lit(8).cast("long"), lambda total, x: total + x)

    ranked = F.sort_array(F.transform(windows, lambda h, p: F.struct(h.alias("h"), p.cast("int").alias("p"))))
    return _let(_let(ranked, places), covered)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each whole text; null texts measure as empty ones, all zero."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(F.col("doc_id").cast("long"), text.alias("text"), words_column(F.col("text").cast("string")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    parts = split.select("doc_id", "text", "words", lines.alias("lines"), _window_hashes(F.col("words")).alias("windows"))
    joined = F.array_join("words", "")
    without = lambda pattern: F.octet_length("text") - F.octet_length(F.regexp_replace("text", pattern, ""))
    return parts.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        without("[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _repeat_words(F.col("windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        without("[A-Z]+").cast("long").alias("n_capitals"),
        without("!+").cast("long").alias("n_shouts"),
        F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        F.size(F.filter(_pairs(F.col("words"), 1, lambda a, b: a == b), lambda same: same)).cast("long").alias("n_stutters"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``fail_bits``: bit r is set where rule r fails.

    Every row of ``docs`` gets one, repeated ones too; other columns are not read.
    """
    bits = F.lit(0).cast("long")
    for r, (_, fails) in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << r)).otherwise(F.lit(0)).cast("long"))
    return measure(docs).withColumn("fail_bits", bits)


def judge(led: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``base_failed`` (few_words or repeated_windows) and ``kept``: no rule of the policy, and no base rule, failed."""
    base = POLICIES["base", 1].mask
    failed = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask)) != 0
    return led.withColumn("base_failed", failed(base)).withColumn("kept", ~failed(base | policy.mask))


def ablation(led: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy keeps without it.

    Documents are first counted by their failing bits within the policy, at most one count a
    combination; rules then read those counts.
    """
    counts = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("docs"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(RULES[r][0]).alias("name"), F.lit(1 << r).cast("long").alias("bit")) for r in policy.rules]))
    each = counts.select("bits", "docs", rules.alias("r")).select("bits", "docs", "r.*")
    some = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("docs"))), F.lit(0))
    return each.groupBy("rule", "name").agg(
        some(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        some(F.col("bits") == F.col("bit")).alias("failed_alone"),
        some((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("kept_without"),
    )
