"""Words of many texts as arrays over their UTF-8 bytes, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
#: Words of more bytes than this are hashed one by one.
_LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one mixing of 64 bits (xor-shifts and odd multipliers)."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


class Block:
    """Some consecutive rows: their bytes, where each row begins, and where each of its words begins and how long it is."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets  # offsets: one more than rows, from 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        space = _SPACE[data]
        before = np.concatenate([[True], space[:-1]]) | edge[:-1] if len(data) else space
        after = np.concatenate([space[1:], [True]]) | edge[1:] if len(data) else space
        kind = np.int32 if len(data) < 1 << 31 else np.int64
        self.begin = np.flatnonzero(~space & before).astype(kind)
        self.size = (np.flatnonzero(~space & after) + 1 - self.begin).astype(kind)
        #: Row i has the words start[i] to start[i + 1].
        self.start = np.searchsorted(self.begin, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64 bits of each word: eight bytes at a time, each folded in by a one-to-one mixing."""
        eight = np.ndarray((len(self.data) + 1,), "<u8", np.concatenate([self.data, np.zeros(9, np.uint8)]).tobytes(), 0, (1,))
        own = np.flatnonzero(self.size > _LONG)
        left = np.where(self.size > _LONG, 8, self.size)
        out = mix(self.size.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        at, live = self.begin, None
        while len(left):
            part = eight[at] & _MASK[np.minimum(left, 8)]
            if live is None:
                out = mix(out ^ part)
            else:
                out[live] = mix(out[live] ^ part)
            more = np.flatnonzero(left > 8)
            live = more if live is None else live[more]
            at, left = at[more] + 8, left[more] - 8
        for i in own.tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.begin[i] : self.begin[i] + self.size[i]].tobytes(), seed)
        return out

    def words(self, row: int) -> list[bytes]:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes().split()


def blocks(texts: pa.ChunkedArray | pa.Array, limit: int = 1_500_000) -> Iterator[tuple[int, Block]]:
    """Cuts a text column into blocks of about ``limit`` bytes, each with its first row; null texts are empty. One longer text is one block."""
    first = 0
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        n = len(chunk)
        if not n:
            continue
        chunk = (chunk.fill_null("") if chunk.null_count else chunk).cast(pa.large_string())
        _, at, raw = chunk.buffers()
        offsets = np.frombuffer(at, "<i8", n + 1, 8 * chunk.offset)
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
            hi = min(max(hi, lo + 1), n, lo + 100_000)
            yield first + lo, Block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            lo = hi
        first += n
