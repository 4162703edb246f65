"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link when at most ``tau`` of their bits differ. The bits are grouped into
partitions of correlated bits, and partition i gets a threshold t_i >= -1 such that the sum of
(t_i + 1) is tau + 1: two fingerprints that differ in at most tau bits then differ in at most t_i
bits of some partition i. A dynamic program picks the thresholds (and the number of partitions) of
least estimated cost. Fingerprints probe with the values of their partitions, and what meets there
is verified on all bits.

Only distinct fingerprints take part, so copies cost nothing. The pairs at a probe value are verified
where they meet if it has few fingerprints. A larger one could make pairs with the square of its
size, so its members are verified through common neighbours instead: two fingerprints differ in at most two bits
exactly if the sets of themselves and their 64 one-bit neighbours meet. That makes 65 rows a member,
whatever the group's size, and is exact, so no group has a cap.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.llm.memory import freeing
from pointlake.llm.text import words_of
from pointlake.operators.components import connected_components
from pointlake.session import materialise

BITS = 64
#: Probe values that more fingerprints share are verified through common neighbours.
SMALL = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """A bit is 1 if it is set in over half of the XXH64 (seed 42) hashes of the shingles, repeats included; no words: 0."""
    words = words_of(text)
    if not words:
        return 0
    words = b"\n".join(words).lower().split(b"\n")
    n = max(1, len(words) - shingle + 1)
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i : i + n] for i in range(shingle)), strict=True))
    return int(majority(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), "<u8", n)))


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 4096):
        ones += np.unpackbits(np.ascontiguousarray(hashes[lo : lo + 4096]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (the 64 bits as a signed long) of every row, where the rows are."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own)], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint long")


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are and, for each pair of bits, in how many both are set: 64 x 64 numbers, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(bits), both + bits.T @ bits
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "both": pa.array([both.ravel().astype(np.int64)], pa.list_(pa.int64()))})

    parts = nodes.select("fingerprint").mapInArrow(run, "n long, both array<long>")
    rows = parts.select("n", F.posexplode("both")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("both")).collect()
    both = np.zeros(BITS * BITS)
    for r in rows:
        both[r["pos"]] = r["both"]
    return (rows[0]["n"] if rows else 0), both.reshape(BITS, BITS)


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Deals the bits into m groups of about equal size, the most correlated bits together.

    Pairs of bits are taken by falling correlation and their groups merged while they fit; left-over
    groups fill the gaps, largest first.
    """
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    room = -(-BITS // m)
    group = {b: [b] for b in range(BITS)}
    for flat in np.argsort(-corr, axis=None, kind="stable"):
        a, b = divmod(int(flat), BITS)
        if a < b and group[a] is not group[b] and len(group[a]) + len(group[b]) <= room:
            merged = group[a] + group[b]
            for x in merged:
                group[x] = merged
    parts = sorted({id(g): sorted(g) for g in group.values()}.values(), key=lambda g: (-len(g), g))
    out: list[list[int]] = [[] for _ in range(m)]
    for g in parts:
        for b in g:  # a group that no longer fits as a whole is split
            fits = [o for o in out if len(o) + len(g) <= room] or [o for o in out if len(o) < room]
            min(fits, key=len).append(b) if b == g[0] else next((o for o in out if g[0] in o and len(o) < room), min((o for o in out if len(o) < room), key=len)).append(b)
    return [sorted(o) for o in out]


def estimated_candidates(n: int, both: np.ndarray, bits: list[int], t: int) -> float:
    """Expected pairs of fingerprints that differ in at most t of these bits.

    Bits differ with chance 2p(1-p); correlated bits differ together, so the group counts as many
    independent bits as its correlation matrix has by the participation ratio of its eigenvalues.
    """
    if t < 0:
        return 0.0
    p = both.diagonal() / max(n, 1)
    q = np.clip(2 * p * (1 - p), 1e-6, 1)[bits]
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = ((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))[np.ix_(bits, bits)]
    np.fill_diagonal(corr, 1)
    share = len(bits) / max(1.0, float((corr**2).sum() / len(bits)))
    chance = np.zeros(t + 1)
    chance[0] = 1
    for x in q:
        chance[1:] = chance[1:] * (1 - x) + chance[:-1] * x
        chance[0] *= 1 - x
    return n * (n - 1) / 2 * float(chance.sum()) ** (share / len(bits))


def allocate(n: int, both: np.ndarray, tau: int, most: int = 6) -> list[tuple[int, int]]:
    """Partitions as (mask, threshold), of the least estimated cost: rows that probe plus candidates to verify.

    For each number of partitions, best[j][r] is the least cost of the first j partitions with
    thresholds that spend r of tau + 1; partition j takes t + 1 of them at the cost of its probes and
    estimated candidates.
    """
    best_plan, best_cost = [((1 << BITS) - 1, tau)], float("inf")
    for m in range(1, most + 1):
        groups = correlated_groups(n, both, m)
        best = [(0.0, [])] + [(float("inf"), [])] * (tau + 1)
        for bits in groups:
            cost = {t: (sum(comb(len(bits), i) for i in range(t + 1)) * n + estimated_candidates(n, both, bits, t) if t >= 0 else 0.0) for t in range(-1, tau + 1)}
            best = [min(((best[r - t - 1][0] + cost[t], best[r - t - 1][1] + [t]) for t in range(-1, r)), key=lambda x: x[0]) for r in range(tau + 2)]
        if best[tau + 1][0] < best_cost:
            best_cost = best[tau + 1][0]
            best_plan = [(sum(1 << b for b in bits), t) for bits, t in zip(groups, best[tau + 1][1], strict=True) if t >= 0]
    return best_plan


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flipped(part: int, value: Column, flips: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(_signed(x)) for x in flips]), lambda x: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(x).alias("key")))


def _probes(value: Column, plan: list[tuple[int, int]]) -> Column:
    """The probe keys of a fingerprint: for each partition its value and all values within the threshold."""
    keys = []
    for k, (mask, t) in enumerate(plan):
        flips = [0]
        bits = [b for b in range(BITS) if mask >> b & 1]
        if t >= 1:
            flips += [1 << b for b in bits]
        if t >= 2:
            flips += [1 << a | 1 << b for i, a in enumerate(bits) for b in bits[i + 1 :]]
        if t > 2:
            raise ValueError("thresholds over 2 are not supported")
        own = value.bitwiseAND(F.lit(_signed(mask)))
        keys.append(_flipped(k, own, flips))
    return F.concat(*keys)


def _verified(tau: int):
    """Turns rows of at most ``SMALL`` fingerprints into links that join those within ``tau`` bits: in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for members in batch.column(0):
                own = np.sort(np.array(members.as_py(), np.int64))
                apart = np.bitwise_count((own[:, None] ^ own[None, :]).view(np.uint64))
                i, j = np.nonzero(np.triu(apart <= tau, 1))
                out += zip(own[i].tolist(), own[j].tolist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["src", "dst"])

    return run


def links(nodes: DataFrame, tau: int = 2) -> DataFrame:
    """Links between distinct fingerprints that connect exactly those that at most ``tau`` (0 to 2) differing bits chain together.

    ``nodes``: distinct ``fingerprint`` values. Returns src, dst. Probe values of up to ``SMALL``
    fingerprints are verified pair by pair, where they are; the members of larger ones meet through
    shared neighbours, a link of each to the least member that shares one.
    """
    if not 0 <= tau <= 2:
        raise ValueError("tau must be 0, 1 or 2")
    plan = allocate(*bit_statistics(nodes), tau)
    probes = nodes.select("fingerprint", F.explode(_probes(F.col("fingerprint"), plan)).alias("p")).select("p.part", "p.key", "fingerprint")
    met = probes.groupBy("part", "key").agg(F.count("*").alias("n"), F.min("fingerprint").alias("src"), F.max("fingerprint").alias("dst")).where("n > 1")
    met = materialise(met, "probes")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= tau
    pairs = met.where("n = 2").where(near("src", "dst")).select("src", "dst")
    small = probes.join(met.where(F.col("n").between(3, SMALL)).select("part", "key"), ["part", "key"])
    small = small.groupBy("part", "key").agg(F.collect_list("fingerprint").alias("members"))  # at most SMALL each
    some = small.select("members").mapInArrow(_verified(tau), "src long, dst long")
    crowded = probes.join(met.where(F.col("n") > SMALL).select("part", "key"), ["part", "key"], "left_semi").select("fingerprint").distinct()
    radius = [0, *(1 << b for b in range(BITS))] if tau == 2 else [0]
    flips = F.array(*[F.lit(_signed(x)) for x in radius])
    ball = crowded.select("fingerprint", F.explode(flips).alias("flip")).select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("key"))
    if tau == 1:
        wide = F.array(*[F.lit(_signed(1 << b)) for b in range(BITS)])
        masked = crowded.select("fingerprint", F.posexplode(wide).alias("bit", "flip"))
        ball = masked.select("fingerprint", F.struct("bit", F.col("fingerprint").bitwiseOR(F.col("flip")).alias("rest")).alias("key"))
    least = ball.groupBy("key").agg(F.min("fingerprint").alias("src"), F.max("fingerprint").alias("top")).where("src < top").select("key", "src")
    shared = ball.join(least, "key").where("src < fingerprint").select("src", F.col("fingerprint").alias("dst"))
    return pairs.union(some).union(shared).distinct()


def near_duplicates(docs: DataFrame, tau: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every row.

    Words are lower-cased in A-Z alone; a text with fewer words than a shingle is one shingle; null
    and empty texts have fingerprint zero and link like any other. component_id is the least
    ``doc_id`` reachable over links, the row's own included (null only where all of them are null).
    Repeated rows are kept. Other columns are not read; an empty table gives no rows.
    """
    own = materialise(fingerprints(docs, shingle), "fingerprints")
    nodes = materialise(own.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "nodes")
    parts = connected_components(links(nodes.select("fingerprint"), tau))
    parts = parts.select(F.col("node").alias("fingerprint"), "component")
    rooted = nodes.join(parts, "fingerprint", "left").select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("component"))
    least = rooted.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialise(rooted.join(least, "component").select("fingerprint", "component_id"), "components")
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return own.join(named, "fingerprint").select("doc_id", hexed, "component_id")
