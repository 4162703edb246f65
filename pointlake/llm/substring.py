"""Substring dedup by level-wise doubling.

A window of ``min_words`` words that occurs in two documents also has its shorter windows in both.
Levels double: 7 words, then 13 (two windows of 7 that share a word), then 25, and so on up to
``min_words``. Only windows that repeat at one level are extended to the next, and the search ends
where no candidates survive.

* The first level takes only anchors: in every run of windows that one target-length (or next-level)
  window spans, the window with the least hash. Both copies of a repeat choose the same anchor, so
  none is missed, and about a quarter of the positions is exchanged.
* A later level takes the windows whose parts repeated at the level before.

Documents are dealt by id to slots, once; all levels read that one exchange. A level sends, for each
slot and hash bucket, one packed array of the slot's distinct window hashes (copies within a slot
are folded before the shuffle, so a passage in a third of all documents costs a bucket one entry a
slot) and gets back one bit a hash. No window or document list is ever gathered. There is at most one
such array for each block that the shuffle has anyway (map task by partition), so they add no order
of growth to it. A slot holds its texts as Arrow bytes; words are arrays of one block of texts at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pointlake.llm.memory import release, text_batches
from pointlake.llm.text import named
from pointlake.llm.wordblocks import Block, blocks, mix
from pointlake.operators.partitioning import deal, slot_keys
from pointlake.session import shuffle_partitions

BASE = 7
_U = np.uint64
_TOP = _U(0xFFFFFFFFFFFFFFFF)
_NONE = np.iinfo(np.int64).min  # a null id, before all others
_SENT = "bucket int, slot int, level int, hashes binary, docs binary"
_ANSWER = "slot int, bucket int, level int, bits binary"


def levels(min_words: int, base: int = BASE) -> list[int]:
    """Window lengths from at most ``base`` up to ``min_words``, each at most twice the one before."""
    out = [min_words]
    while out[0] > base:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _shifted(x: np.ndarray, by: int, fill) -> np.ndarray:
    """x moved left by ``by``."""
    return np.concatenate([x[by:], np.full(min(by, len(x)), fill, x.dtype)]) if by else x


def windows(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of ``length`` consecutive items from each position, by doubling; those that run off the end mean nothing."""
    have, out = 1, mix(words + _U(0x9E3779B97F4A7C15))
    while have < length:
        step = min(have, length - have)
        out = mix(out * _U(0x9FB21C651E98DF25) + mix(_shifted(out, step, _U(0)) + _U(have + 977 * step)))
        have += step
    return out


def _sliding(x: np.ndarray, width: int, pick, fill) -> np.ndarray:
    """pick (minimum or maximum) over x[i : i + width] for each i."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = pick(out, _shifted(out, step, fill))
        have += step
    return out


class _Windows:
    """The windows of one block of words."""

    def __init__(self, block: Block, docs: np.ndarray):
        self.block, self.docs = block, docs
        self.hash = block.hashes()
        sizes = np.diff(block.start)
        self.left = np.repeat(block.start[1:], sizes) - np.arange(len(self.hash))  # words from here to the document's end

    def doc(self, at: np.ndarray) -> np.ndarray:
        """The document of each word position."""
        return self.docs[np.searchsorted(self.block.start, at, "right") - 1]

    def fits(self, length: int) -> np.ndarray:
        return self.left >= length

    def anchors(self, base: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of ``base`` words, the least of them in each window of ``target``, and which positions are such a least."""
        span = target - base + 1
        own = np.maximum(windows(self.hash, base), _U(1))
        least = _sliding(np.where(self.fits(base), own, _TOP), span, np.minimum, _TOP)
        valid = self.fits(target)
        reach = np.where(valid, least, _U(0))
        back = _sliding(reach[::-1], span, np.maximum, _U(0))[::-1]  # over the windows that cover a position
        return own, least, (back == own) & self.fits(base)

    def candidates(self, k: int, lengths: list[int], answers: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the candidate windows of level k and their hashes. answers: level -> sorted hashes that repeat."""
        if len(lengths) == 1:
            at = np.flatnonzero(self.fits(lengths[0]))
            return at, windows(self.hash, lengths[0])[at]
        own, least, chosen = self.anchors(lengths[0], lengths[1])
        for i in range(k):
            repeats = np.zeros(len(own), bool)
            repeats[chosen] = _among(own[chosen], answers[i])
            if i == 0:
                # a window goes on if its own least anchor repeats
                again = _sliding(np.where(repeats, own, _TOP), lengths[1] - lengths[0] + 1, np.minimum, _TOP)
                chosen = (again == least) & (again != _TOP) & self.fits(lengths[1])
            else:
                chosen = repeats & _shifted(repeats, lengths[i + 1] - lengths[i], False) & self.fits(lengths[i + 1])
            own = windows(self.hash, lengths[i + 1])
        at = np.flatnonzero(chosen)
        return at, own[at]


class _Slot:
    """One slot's documents, and the distinct candidate windows of a level."""

    def __init__(self, table: pa.Table, lengths: list[int]):
        self.lengths = lengths
        self.docs, self.texts = table.column("doc_id").fill_null(_NONE).to_numpy(), table.column("text")

    def windows(self) -> Iterator[_Windows]:
        """Block by block; words are found and hashed anew each time, so that one block's arrays are held at once."""
        for first, b in blocks(self.texts):
            yield _Windows(b, self.docs[first : first + len(b)])

    def distinct(self, k: int, answers: dict[int, np.ndarray]) -> _Distinct:
        return _Distinct(self.windows(), k, self.lengths, answers)


class _Distinct:
    """The distinct candidate windows of a level in order of their hashes, with the least and greatest document that has each.

    Up to the last level one 64-bit hash tells windows apart and may only let too much pass; at the
    last there is a second one, over another hash of each word.
    """

    def __init__(self, parts: Iterator[_Windows], k: int, lengths: list[int], answers: dict[int, np.ndarray]):
        last = k == len(lengths) - 1
        self.at: list[np.ndarray] = []
        columns: list[list[np.ndarray]] = [[np.empty(0, _U)], [np.empty(0, np.int64)], [np.empty(0, _U)]]
        for w in parts:
            at, own = w.candidates(k, lengths, answers)
            self.at.append(at)
            columns[0].append(own)
            columns[1].append(w.doc(at))
            if last and len(at):
                columns[2].append(windows(w.block.hashes(1), lengths[k])[at])
        keys, docs, second = map(np.concatenate, columns)
        second = second if last else None
        order = np.argsort(keys, kind="stable") if second is None else np.lexsort((second, keys))
        keys, docs = keys[order], docs[order]
        new = _changes(keys) if second is None else _changes(keys) | _changes(second[order])
        begin = np.flatnonzero(new)
        self.keys, self.second = keys[begin], None if second is None else second[order][begin]
        self.least = np.minimum.reduceat(docs, begin) if len(begin) else docs
        self.most = np.maximum.reduceat(docs, begin) if len(begin) else docs
        self.group = np.empty(len(keys), np.int64)  # of each candidate, in block order
        self.group[order] = np.cumsum(new) - 1


def _changes(x: np.ndarray) -> np.ndarray:
    """Which items differ from the one before; the first does."""
    return np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.empty(0, bool)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((mix(keys + _U(0x2545F4914F6CDD1D)) >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def marks(keys: np.ndarray, n: int, bits: dict[int, bytes], buckets: list[int]) -> np.ndarray:
    """The answers to ``keys``, sorted as they were sent: a bit each, by bucket."""
    out, where = np.zeros(len(keys), bool), bucket_of(keys, n)
    for j in np.unique(where):
        own = np.flatnonzero(where == j)
        out[own] = np.unpackbits(np.frombuffer(bits[buckets[j]], np.uint8), count=len(own)).astype(bool)
    return out


def narrow(keys: np.ndarray, several: np.ndarray) -> bytes:
    """Hashes as 40 bits with the lowest one telling whether several owners in the slot have it."""
    packed = ((keys >> _U(25)) << _U(1)) | several.astype(_U)
    return packed.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _wide(raw: bytes) -> np.ndarray:
    five = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return np.concatenate([five, np.zeros((len(five), 3), np.uint8)], 1).reshape(-1).view("<u8")


def shared(bodies: list[bytes]) -> list[bytes]:
    """For each slot's ``narrow`` hashes of one bucket, a bit each: whether another slot, or several owners in one, have it."""
    keys = [_wide(x) for x in bodies]
    flat = np.concatenate(keys)
    several, flat = (flat & _U(1)).astype(bool), flat >> _U(1)
    order = np.argsort(flat, kind="stable")
    start = np.flatnonzero(_changes(flat[order]))
    length = np.diff(np.concatenate([start, [len(flat)]]))
    yes = np.empty(len(flat), bool)
    yes[order] = np.repeat((length > 1) | np.logical_or.reduceat(several[order], start), length)
    return _bits(yes, [len(x) for x in keys])


def _bits(yes: np.ndarray, sizes: list[int]) -> list[bytes]:
    ends = np.cumsum(sizes)
    return [np.packbits(yes[e - s : e]).tobytes() for s, e in zip(sizes, ends, strict=True)]


def sent(rows: list[tuple], names: Sequence[str] = ("bucket", "slot", "level", "hashes", "docs")) -> pa.Table:
    """Packed arrays as a table: three numbers and then bytes a row."""
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    kinds = [pa.int32()] * 3 + [pa.binary()] * (len(names) - 3)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], list(names))


def remove_repeats(docs: DataFrame, min_words: int = 13, base: int = BASE, carry: Sequence[str] = ()) -> DataFrame:
    """Removes each word that a window covers whose ``min_words`` words also start in a document with a smaller id.

    Returns doc_id, n_words, n_removed, kept_sha256, kept (the kept words joined by one space).
    Windows are judged on the input. Words are compared as they are; windows do not cross documents.
    Null and empty texts have no words. Repeats within one document stay. A null id counts as
    smaller than all others; rows of one id are one document to each other: none removes the other's
    words. An empty table gives no rows. Of other columns only those in ``carry`` are read; they come
    back in a struct ``rest``, and then ``kept`` is the text as it was, or null, where nothing is removed.

    Levels before the last compare 39 bits of each hash within a bucket and may only let too much
    pass; the last compares two hashes of 64 bits, over different hashes of each word.
    """
    spark = docs.sparkSession
    text_batches(spark)
    n, lengths = shuffle_partitions(spark), levels(min_words, base)
    buckets, last = slot_keys(n), len(lengths) - 1
    rest = F.struct(*[c for c, name in zip(named(docs), docs.columns, strict=True) if name in carry]) if carry else F.lit(None).cast("struct<none:int>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))
    dealt = deal(rows, F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"), n).select("slot", "doc_id", "text", "rest")

    def packed(slot_id: int, found: _Distinct, level: int) -> pa.Table:
        where = bucket_of(found.keys, n)
        order = np.argsort(where, kind="stable")
        cut = np.searchsorted(where[order], np.arange(n + 1))
        out = []
        for j in np.unique(where):
            own = order[cut[j] : cut[j + 1]]
            if level < last:
                body, extra = narrow(found.keys[own], found.most[own] > found.least[own]), b""
            else:
                body, extra = found.keys[own].astype("<u8").tobytes(), found.second[own].astype("<u8").tobytes() + found.least[own].astype("<i8").tobytes()
            out.append((buckets[j], slot_id, level, body, extra))
        return sent(out)

    def answers(slot: _Slot, right: pa.Table, upto: int) -> dict[int, np.ndarray]:
        """Level -> hashes that repeat in another document, for the levels below ``upto``."""
        got: dict[int, np.ndarray] = {}
        bits = _answered(right)
        for k in range(upto):
            keys = slot.distinct(k, got).keys
            got[k] = keys[marks(keys, n, bits.get(k, {}), buckets)]
        return got

    def first_level(table: pa.Table) -> pa.Table:
        out = packed(table.column("slot")[0].as_py(), _Slot(table, lengths).distinct(0, {}), 0)
        release()
        return out

    def next_level(level: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return sent([])
            slot = _Slot(left, lengths)
            out = packed(left.column("slot")[0].as_py(), slot.distinct(level, answers(slot, right, level)), level)
            release()
            return out

        return run

    def decide(table: pa.Table) -> pa.Table:
        level = table.column("level")[0].as_py()
        bodies, extras = table.column("hashes").to_pylist(), table.column("docs").to_pylist()
        if level < last:
            bits = shared(bodies)
        else:
            keys = [np.frombuffer(x, "<u8") for x in bodies]
            sizes = [len(x) for x in keys]
            flat = np.concatenate(keys)
            second, least = (np.concatenate([np.frombuffer(x, kind, s, off * s) for x, s in zip(extras, sizes, strict=True)]) for kind, off in (("<u8", 0), ("<i8", 8)))
            order = np.lexsort((second, flat))
            start = np.flatnonzero(_changes(flat[order]) | _changes(second[order]))
            length = np.diff(np.concatenate([start, [len(flat)]]))
            yes = np.empty(len(flat), bool)
            yes[order] = least[order] > np.repeat(np.minimum.reduceat(least[order], start), length)
            bits = _bits(yes, sizes)  # one bit: another slot has a smaller document than this slot's least
        return sent([*zip(table.column("slot").to_pylist(), table.column("bucket").to_pylist(), [level] * len(bits), bits, strict=True)], ("slot", "bucket", "level", "bits"))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        slot = _Slot(left, lengths)
        out: list[list] = [[], [], [], []]
        if left.num_rows:
            found = slot.distinct(last, answers(slot, right, last))
            elsewhere = marks(found.keys, n, _answered(right).get(last, {}), buckets)
            done = 0
            for w, at in zip(slot.windows(), found.at, strict=True):
                group = found.group[done : done + len(at)]
                done += len(at)
                starts = at[elsewhere[group] | (found.least[group] < w.doc(at))]
                change = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(change, starts, 1)
                np.add.at(change, starts + lengths[-1], -1)
                gone = np.cumsum(change[:-1]) > 0
                begin = w.block.start
                for i in range(len(w.block)):
                    lost = gone[begin[i] : begin[i + 1]]
                    words, removed = w.block.words(i), int(lost.sum())
                    kept = b" ".join([x for x, g in zip(words, lost.tolist(), strict=True) if not g] if removed else words)
                    for column, value in zip(out, (len(words), removed, hashlib.sha256(kept).hexdigest(), None if carry and not removed else kept.decode("utf-8", "surrogatepass")), strict=True):
                        column.append(value)
        columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
        if carry:
            columns[3] = pc.coalesce(columns[3], left.column("text").cast(pa.string()))
        del slot
        release()
        return pa.Table.from_arrays([left.column("doc_id"), *columns, left.column("rest")], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "rest"])

    grouped = dealt.groupBy("slot")
    message = grouped.applyInArrow(lambda t: first_level(t), _SENT)
    known = None
    for level in range(last + 1):
        reply = message.repartition(n, "bucket").groupBy("bucket").applyInArrow(lambda t: decide(t), _ANSWER)
        known = reply if known is None else known.union(reply)
        if level < last:
            message = grouped.cogroup(known.groupBy("slot")).applyInArrow(next_level(level + 1), _SENT)
    kinds = StructType([*(StructField(c, LongType()) for c in ("doc_id", "n_words", "n_removed")), *(StructField(c, StringType()) for c in ("kept_sha256", "kept")), rows.schema["rest"]])
    out = grouped.cogroup(known.groupBy("slot")).applyInArrow(lambda left, right: finish(left, right), kinds)
    return out if carry else out.drop("rest")


def without_repeats(docs: DataFrame, min_words: int = 13) -> DataFrame:
    """``docs``, all rows and columns, with ``text`` less the words that ``remove_repeats`` removes; ``n_chars``, if there, follows.

    Texts that lose no word stay as they are, white space and all; null texts stay null. Columns may
    have any names. An empty table gives no rows.
    """
    found = remove_repeats(docs, min_words, carry=[c for c in docs.columns if c != "text"])

    def column(name: str) -> Column:
        if name == "text":
            return F.col("kept").alias(name)
        if name == "n_chars":
            return F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema[name].dataType)).otherwise(F.col("rest")[name]).alias(name)
        return F.col("rest")[name].alias(name)

    return found.select(*map(column, docs.columns))


def _answered(right: pa.Table) -> dict[int, dict[int, bytes]]:
    """level -> bucket -> bits."""
    out: dict[int, dict[int, bytes]] = {}
    for r in right.to_pylist():
        out.setdefault(r["level"], {})[r["bucket"]] = r["bits"]
    return out
