"""Sum-of-squares packing of token sequences.

Every document is tokenised once; documents longer than a sequence are cut into whole sequences and
a rest. Pieces then go, longest first, where the sum over gaps of (open bins with that gap) squared
grows least; a bin closes when it is full. The rule keeps gaps diverse, so that later pieces find an
exact fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.llm.memory import freeing, text_batches
from pointlake.llm.tokens import encoder
from pointlake.operators.partitioning import deal
from pointlake.session import materialise

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = f"{_PIECES}, sequence_id long, offset long"


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins and offsets of pieces (each 1..capacity long), placed in the order given.

    Placing a piece of size s in a bin of gap g turns N(g) bins of that gap into N(g)-1 and N(g-s)
    into one more, so the sum of squares changes by 2(N(g-s)-N(g))+2, or by 1-2N(s) when it fills
    the bin. The least change wins: an exact fit on ties, then the tightest gap. A new bin is opened
    only where no open bin has room, since the number of sequences is what counts here. Memory and
    time a piece depend on the capacity alone.
    """
    counts = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by gap
    out, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    none = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        here = counts[s + 1 : capacity]
        change = np.where(here > 0, 2 * (counts[1 : 1 + len(here)] - here) + 2, none)
        best = int(change.argmin()) if len(change) else 0
        least = int(change[best]) if len(change) else none
        if bins[s] and 1 - 2 * int(counts[s]) <= least:
            gap = s
        elif least < none:
            gap = s + 1 + best
        else:
            gap = 0
        if gap:
            b = bins[gap].pop()
            counts[gap] -= 1
        else:
            b, gap = made, capacity
            made += 1
        out[i], offsets[i] = b, capacity - gap
        if gap > s:
            bins[gap - s].append(b)
            counts[gap - s] += 1
    return out, offsets


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids and end id, cut at ``capacity``.

    Null and empty texts hold the end id alone. Runs where the rows are, without a shuffle.
    """

    @freeing
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo : lo + 4 * capacity]
                    for column, value in zip(rows, (doc, k, lo // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, _PIECES)


def pack_sequences(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, lot: int = 200_000) -> DataFrame:
    """Packs documents into sequences of at most ``capacity`` tokens.

    Returns a row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and
    empty texts are documents of one token; repeated rows are packed as often as they occur; other
    columns are not read; an empty table gives no rows.

    Pieces (a few numbers each, no texts) are written once, then dealt at random to lots of about
    ``lot`` pieces that are packed independently: a lot wastes less than a few open sequences, so
    the loss against one global packing is a few sequences in each ``lot`` pieces, at any size.
    """
    text_batches(docs.sparkSession)
    pieces = materialise(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    n = max(1, -(-pieces.count() // lot))
    mixed = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()) if n > 1 else F.lit(0)
    index = F.pmod(mixed, F.lit(n)).cast("int")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        lots = table.column("lot").to_numpy()
        for k in np.unique(lots):
            own = table.filter(pa.array(lots == k))
            sizes = own.column("length").to_numpy()
            order = np.argsort(-sizes, kind="stable")
            own = own.take(pa.array(order))
            at, offsets = sum_of_squares(sizes[order], capacity)
            whole = own.drop_columns(["lot"]).append_column("sequence_id", pa.array(at * n + int(k))).append_column("offset", pa.array(offsets))
            yield from whole.combine_chunks().to_batches(10_000)

    dealt = deal(pieces.withColumn("lot", index.cast("long")), index, n)
    return dealt.drop("slot").mapInArrow(pack, _PACKED)
