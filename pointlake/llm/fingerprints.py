"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A sketch has cells of (count, xor of digests, xor of check digests) in three thirds; every digest falls
in one cell of each. Two sketches subtract cell by cell. What remains holds only the digests in one
document and not the other; cells with one digest left are peeled off until nothing is left, which
recovers the digests themselves.

The size of a document's sketch follows from its text alone: the least power of two, from half a
digest a third on, at which the sketch peels down to nothing by itself. A larger sketch folds to any
smaller size by adding cells, so two fingerprints compare at a small size first and, if peeling stops
early, at one four times as large, up to the smaller of the two; beyond that each is peeled by itself.
Whatever two fingerprints say of their documents therefore comes from the two fingerprints.

All documents of a batch are sketched, folded, subtracted and peeled together as arrays.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.llm.memory import freeing, text_batches
from pointlake.operators.partitioning import cut_points, deal, range_index
from pointlake.session import shuffle_partitions

#: Cells of the least sketch, and how much larger the next comparison is.
CELLS, GROWTH = 24, 4
_U = np.uint64
#: Within a sentence a paragraph ends after a word whose length is a multiple of this, if it has so many words by then.
LENGTH, RUN = 4, 4
_LINE_PART = re.compile(r"[^.!?]*[.!?]*")
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long, lost array<long>, gained array<long>, retries int"


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing function (xor-shifts and odd multipliers)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def paragraphs(text: str) -> list[str]:
    """The paragraphs of a text: sentences of its lines, long ones cut where their own words say, white space within as one space.

    A cut depends on the words before it back to the last cut alone, so an insertion changes the
    paragraphs around it and not the rest of the line. Blank ones are left out.
    """
    out = []
    for line in text.split("\n"):
        for part in _LINE_PART.findall(line):
            words = part.split()
            lo = 0
            for i, w in enumerate(words, 1):
                if i - lo >= RUN and len(w) % LENGTH == 0:
                    out.append(" ".join(words[lo:i]))
                    lo = i
            if lo < len(words):
                out.append(" ".join(words[lo:]))
    return out


def digests(text: str | None) -> np.ndarray:
    """Distinct 64-bit digests of the paragraphs; the n-th repeat of one has a digest of its own, so that sketches hold multisets."""
    own = np.array([xxhash.xxh64_intdigest(p) for p in paragraphs(text)] if text else [], _U)
    if len(own) > 1:
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        if not first.all():
            at = np.arange(len(own))
            repeat = at - np.maximum.accumulate(np.where(first, at, 0))
            own[order] = np.where(repeat > 0, _mix(ranked + repeat.astype(_U) * _U(0x9E3779B97F4A7C15)), ranked)
            while len(same := np.setdiff1d(np.arange(len(own)), np.unique(own, return_index=True)[1])):
                own[same] += _U(1)  # repeats whose digests meet
    return own


class Sketches:
    """Sketches of many documents: document i has ``cells[i]`` cells (three times a power of two) from ``base[i]``."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells.astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.cells)])
        self.count = np.zeros(self.base[-1], np.int64)
        self.key = np.zeros(self.base[-1], _U)
        self.check = np.zeros(self.base[-1], _U)

    def places(self, owner: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
        third = self.cells[owner] // 3
        return [self.base[owner] + j * third + (_mix(keys + _U(0x632BE59BD9B4E019 * (j + 1) & (1 << 64) - 1)) & (third - 1).astype(_U)).astype(np.int64) for j in range(3)]

    @staticmethod
    def checks(keys: np.ndarray) -> np.ndarray:
        return _mix(keys ^ _U(0xD6E8FEB86659FD93)) & _U(0xFFFFFFFF)

    def add(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> None:
        check = self.checks(keys)
        for at in self.places(owner, keys):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, check)

    def text(self, i: int) -> str:
        """Document i's sketch as base64 of its counts (32 bits), digests (64) and checks (32)."""
        a, b = self.base[i], self.base[i + 1]
        raw = self.count[a:b].astype("<i4").tobytes() + self.key[a:b].astype("<u8").tobytes() + self.check[a:b].astype("<u4").tobytes()
        return base64.b64encode(raw).decode()

    @classmethod
    def parse(cls, texts: list[str]) -> Sketches:
        """The sketches that ``text`` wrote."""
        raws = [base64.b64decode(t) for t in texts]
        out = cls(np.array([len(r) // 16 for r in raws], np.int64))
        parts = [(np.frombuffer(r, "<i4", n), np.frombuffer(r, "<u8", n, 4 * n), np.frombuffer(r, "<u4", n, 12 * n)) for r, n in zip(raws, out.cells.tolist(), strict=True)]
        for name, values in zip(("count", "key", "check"), zip(*parts, strict=True), strict=False):
            setattr(out, name, np.concatenate(values).astype(getattr(out, name).dtype))
        return out

    def take(self, rows: np.ndarray) -> Sketches:
        out = Sketches(self.cells[rows])
        at = np.arange(out.base[-1]) + np.repeat(self.base[rows] - out.base[:-1], out.cells)
        out.count, out.key, out.check = self.count[at], self.key[at], self.check[at]
        return out

    def folded(self, cells: np.ndarray) -> Sketches:
        """The same sets in sketches of ``cells``, at most the present ones."""
        out = Sketches(cells)
        owner = np.repeat(np.arange(len(cells)), self.cells)
        local, third = np.arange(self.base[-1]) - self.base[owner], self.cells[owner] // 3
        fewer = out.cells[owner] // 3
        to = out.base[owner] + local // third * fewer + (local % third & fewer - 1)
        out.count = np.bincount(to, self.count, out.base[-1]).astype(np.int64)
        np.bitwise_xor.at(out.key, to, self.key)
        np.bitwise_xor.at(out.check, to, self.check)
        return out

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.cells)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """By document the digests of the plus side and of the minus side, and which documents were peeled to nothing. Uses the sketches up."""
        n = len(self.cells)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        owner_of = np.repeat(np.arange(n), self.cells)
        live = np.flatnonzero(np.abs(self.count) == 1)
        while len(live):
            pure = live[(np.abs(self.count[live]) == 1) & (self.check[live] == self.checks(self.key[live]))]
            if not len(pure):
                break
            owner, keys, sign = owner_of[pure], self.key[pure], self.count[pure]
            # the same digest may be alone in several of its cells
            _, first = np.unique(_mix(keys) + owner.astype(_U) * _U(0x9E3779B97F4A7C15), return_index=True)
            owner, keys, sign = owner[first], keys[first], sign[first]
            found.append((owner, keys, sign))
            self.add(owner, keys, -sign)
            live = np.unique(np.concatenate(self.places(owner, keys)))
        bad = (self.count != 0) | (self.key != 0) | (self.check != 0)
        done = np.bincount(owner_of[bad], minlength=n) == 0
        sides = []
        for wanted in (1, -1):
            owner, keys = (np.concatenate([np.empty(0, t), *(f[k][f[2] == wanted] for f in found)]) for k, t in ((0, np.int64), (1, _U)))
            order = np.argsort(owner, kind="stable")
            sides.append(np.split(keys[order], np.cumsum(np.bincount(owner, minlength=n))[:-1]) if n else [])
        return sides[0], sides[1], done


def _build(sets: list[np.ndarray], cells: np.ndarray) -> Sketches:
    s = Sketches(cells)
    if sets:
        s.add(np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets), 1)
    return s


def fingerprints(sets: list[np.ndarray]) -> tuple[Sketches, np.ndarray]:
    """The sketch of each set of distinct digests and how often it had to grow until it peeled to nothing.

    Distinct digests part in the end as sizes double, so the loop ends.
    """
    n = np.array([len(x) for x in sets], np.int64)
    third = np.maximum(CELLS // 3, 1 << np.ceil(np.log2(np.maximum(n, 1) / 2)).clip(0).astype(np.int64))
    grown, todo = np.zeros(len(sets), np.int64), np.arange(len(sets))
    while len(todo):
        _, _, done = _build([sets[i] for i in todo], 3 * third[todo]).peel()
        todo = todo[~done]
        third[todo] *= 2
        grown[todo] += 1
    return _build(sets, 3 * third), grown


def differences(a: Sketches, b: Sketches) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """By pair of fingerprints: the digests only in a, those only in b, and how often the comparison had to grow."""
    n = len(a.cells)
    only_a, only_b = [np.empty(0, _U)] * n, [np.empty(0, _U)] * n
    tries, most = np.zeros(n, np.int64), np.minimum(a.cells, b.cells)
    todo, size = np.arange(n), CELLS
    while len(todo):
        cells = np.minimum(most[todo], size)
        plus, minus, done = a.take(todo).folded(cells).minus(b.take(todo).folded(cells)).peel()
        last = ~done & (cells == most[todo])
        for k in np.flatnonzero(done).tolist():
            only_a[todo[k]], only_b[todo[k]] = plus[k], minus[k]
        whole = todo[last]
        if len(whole):
            left, right = a.take(whole).peel()[0], b.take(whole).peel()[0]
            for i, x, y in zip(whole.tolist(), left, right, strict=True):
                only_a[i], only_b[i] = np.setdiff1d(x, y, True), np.setdiff1d(y, x, True)
        tries[todo[~done]] += 1
        todo, size = todo[~done & ~last], size * GROWTH
    return only_a, only_b, tries


def likeness(n_before: np.ndarray, n_after: np.ndarray, only_before: np.ndarray, only_after: np.ndarray) -> np.ndarray:
    """Common digests over all digests of both; 1 if neither has any."""
    common, total = n_before - only_before, n_before + only_after
    return np.where(total > 0, common / np.maximum(total, 1), 1.0)


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    known: dict[str, int] = {}
    sets: list[np.ndarray] = []

    def place(text: str) -> int:
        if text not in known:
            known[text] = len(sets)
            sets.append(digests(text))
        return known[text]

    texts = [_edited(t, f) for _, t, f in rows]
    own, after, following = (np.array([place(t) for t in side], np.int64) for side in ([t for _, t, _ in rows], texts, [f for _, _, f in rows]))
    made, grown = fingerprints(sets)
    mine = made.take(own)
    size = np.array([len(x) for x in sets], np.int64)
    lost, gained, tries = differences(mine, made.take(after))
    gone, new, more = differences(mine, made.take(following))
    count = lambda side: np.array([len(x) for x in side], np.int64)
    lists = lambda side: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, side)]), pa.int32()), pa.array(np.concatenate([np.empty(0, _U), *side]).view(np.int64)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, _, _ in rows], pa.int64()),
            pa.array([len(t) for _, t, _ in rows], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]),
            pa.array([made.text(i) for i in own.tolist()]),
            pa.array([made.text(i) for i in after.tolist()]),
            pa.array(likeness(size[own], size[after], count(lost), count(gained))),
            pa.array(likeness(size[own], size[following], count(gone), count(new))),
            pa.array(size[own], pa.int64()),
            lists(lost),
            lists(gained),
            pa.array(grown[own] + np.maximum(tries, more), pa.int32()),
        ],
        [x.split()[0] for x in _OUT.split(", ")],
    )


def fingerprint_documents(docs: DataFrame, batch_chars: int = 2_000_000) -> DataFrame:
    """Fingerprints every whole text and its edited text, and says how alike the fingerprints are.

    ``lost`` and ``gained`` are the digests that peeling recovers: those of the text's paragraphs that
    the edited text lacks, and the other way round.

    The edited text replaces the last half of the characters by the first as many of the next
    document (ascending ``doc_id``; null ids first, rows of one id by text; after the last comes the
    first). Null texts count as empty. Two empty texts are alike (1), an empty and a non-empty one
    are not (0). Repeated rows are kept, each with its own follower. A table of one document follows
    itself; an empty table gives no rows. Other columns are not read.

    Ranges of ids go to one task each with one more row, the first of the next range, so neighbours
    meet without a global window and texts are shuffled once. Those first rows are the cut points,
    so which rows travel twice is known before the shuffle.
    """
    spark = docs.sparkSession
    text_batches(spark)
    n = shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = cut_points(rows, "doc_id", n)
    index = range_index(F.col("doc_id"), cuts)
    ends = rows.agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull().cast("int")).alias("nulls")).first()
    if cuts and cuts[0] == ends["least"] and not ends["nulls"]:
        cuts = cuts[1:]  # the first range would be empty
        index = range_index(F.col("doc_id"), cuts)
    last = len(cuts)
    is_head = F.col("doc_id").isNull() if ends["nulls"] else F.col("doc_id") == F.lit(ends["least"])
    is_head = is_head | F.col("doc_id").isin(cuts) if cuts else is_head
    main = rows.select("*", F.lit(0).alias("guest"), index.cast("int").alias("part"))
    guests = rows.where(is_head).groupBy("doc_id").agg(F.min("text").alias("text"))
    guests = guests.select("*", F.lit(1).alias("guest"), F.pmod(index.cast("int") - 1, F.lit(last + 1)).alias("part"))
    dealt = deal(main.union(guests), F.col("part"), last + 1).sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "text")

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple[int | None, str, str]] = []
        held, chars = None, 0
        for batch in batches:
            at = batch.schema.get_field_index
            for doc, text, guest in zip(batch.column(at("doc_id")).to_pylist(), batch.column(at("text")), batch.column(at("guest")).to_pylist(), strict=True):
                text = text.as_py()
                if held is not None:
                    ready.append((*held, text))
                    chars += len(text)
                held = None if guest else (doc, text)
                if chars > batch_chars:
                    yield _compare(ready)
                    ready, chars = [], 0
        if ready:
            yield _compare(ready)

    return dealt.drop("slot").mapInArrow(run, _OUT)
