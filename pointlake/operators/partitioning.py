"""Deals rows to partitions exactly: one slot, one partition.

Spark sends a row to partition ``pmod(murmur3(key), n)``. Plain numbers 0..n-1 as keys collide, so
some tasks would get three slots and others none. The functions here invert that hash and use keys
that land one in each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_M = 0xFFFFFFFF


def _rotate(x: int, n: int) -> int:
    return ((x << n) | (x >> (32 - n))) & _M


def murmur3_int(key: int, seed: int = 42) -> int:
    """Spark's ``hash`` of one int, as an unsigned number."""
    k = _rotate((key & _M) * 0xCC9E2D51 & _M, 15) * 0x1B873593 & _M
    h = (_rotate(seed ^ k, 13) * 5 + 0xE6546B64) & _M
    h ^= 4
    h = (h ^ h >> 16) * 0x85EBCA6B & _M
    h = (h ^ h >> 13) * 0xC2B2AE35 & _M
    return h ^ h >> 16


def murmur3_int_inverse(h: int, seed: int = 42) -> int:
    """The signed int whose ``hash`` is ``h``."""
    h = (h ^ h >> 16) * pow(0xC2B2AE35, -1, 1 << 32) & _M
    h = (h ^ h >> 13 ^ h >> 26) * pow(0x85EBCA6B, -1, 1 << 32) & _M
    h ^= h >> 16
    h ^= 4
    k = seed ^ _rotate((h - 0xE6546B64) * pow(5, -1, 1 << 32) & _M, 19)
    k = _rotate(k * pow(0x1B873593, -1, 1 << 32) & _M, 17) * pow(0xCC9E2D51, -1, 1 << 32) & _M
    return k - (1 << 32) if k >> 31 else k


def slot_keys(n: int) -> list[int]:
    """Keys 0..n-1 -> ints of which the i-th goes to partition i of n."""
    return [murmur3_int_inverse(i) for i in range(n)]


def slot_key(index: Column, n: int) -> Column:
    """The key of slot ``index`` (0..n-1) as a column."""
    return F.element_at(F.array(*[F.lit(k) for k in slot_keys(n)]), (index + 1).cast("int"))


def deal(df: DataFrame, index: Column, n: int, name: str = "slot") -> DataFrame:
    """Adds ``name``, the key of slot ``index``, and sends each slot to a partition of its own."""
    return df.withColumn(name, slot_key(index, n)).repartition(n, name)


def cut_points(df: DataFrame, key: str, n: int) -> list:
    """At most n-1 values of ``key`` that cut ``df`` into ranges of about equal row counts.

    One pass over the key column alone; the result has one value a partition, so it is bounded by
    the partition count. Nulls come before all cut points.
    """
    if n < 2:
        return []
    at = [i / n for i in range(1, n)]
    got = df.select(F.percentile_approx(key, at, max(10_000, 50 * n)).alias("q")).first()["q"]
    return sorted(set(got or []))


def range_index(key: Column, cuts: list) -> Column:
    """The ordinal of the range that ``key`` is in: the number of cut points at or below it; null: 0.

    A binary search whose steps are nested lambdas, so that each step names the position before it
    once and the expression grows with the logarithm of the cut points.
    """
    if not cuts:
        return F.lit(0)
    points = F.array(*[F.lit(c) for c in cuts])
    step = 1
    while 2 * step <= len(cuts):
        step *= 2
    at = F.lit(0)
    while step:
        at = _forward(at, step, points, key)
        step //= 2
    return F.when(key.isNull(), F.lit(0)).otherwise(at)


def _forward(at: Column, step: int, points: Column, key: Column) -> Column:
    """``at`` moved by ``step`` if the point before that place is at or below ``key``; past the end there is none (null)."""
    return F.get(F.transform(F.array(at), lambda a: F.when(F.get(points, a + (step - 1)) <= key, a + step).otherwise(a)), F.lit(0))
