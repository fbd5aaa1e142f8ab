"""Vectorised words and hashes over Arrow string columns.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. Its hash takes
eight bytes at a time into a 64-bit state that is mixed, not linearly, after each;
the rare words of more than ``LANES`` such steps go through BLAKE2b. Hashes of runs of
words are built from these by doubling, mixed at each step. Memory follows the
chunk of words, not the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one pass of a kernel holds, unless one document has more.
PIECE = 4 << 20
#: Words hashed at once.
CHUNK = 1 << 16
#: Steps of eight bytes of a word that are hashed column by column.
LANES = 8

_SEED = np.random.Generator(np.random.PCG64(20240607))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd multipliers that combine neighbouring hashes.
MULT = _SEED.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The bytes of a lane that n bytes fill.
_FILLED = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values, in place."""
    t = x >> np.uint64(30)
    x ^= t
    x *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(x, np.uint64(27), out=t)
    x ^= t
    x *= np.uint64(0x94D049BB133111EB)
    np.right_shift(x, np.uint64(31), out=t)
    x ^= t
    return x


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets in them; null counts as empty."""
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


class Words:
    """Words of all rows of a string column: byte ranges, and where each row's words start."""

    def __init__(self, column: pa.Array):
        self.data, self.rows = raw(column)
        n = len(self.data)
        word = ~_SPACE[self.data]
        first, last = word.copy(), word.copy()
        if n:
            joined = word[1:] & word[:-1]
            cuts = self.rows[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < n)]
            joined[cuts - 1] = False
            first[1:] &= ~joined
            last[:-1] &= ~joined
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        #: self.at[i]:self.at[i + 1] are the words of row i.
        self.at = np.searchsorted(self.starts, self.rows)

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def hashes(self, lower: bool = False) -> np.ndarray:
        data = np.zeros(len(self.data) + 8, np.uint8)  # the last lane reads past the end
        data[:-8] = _LOWER[self.data] if lower else self.data
        lanes = np.ndarray(max(len(data) - 7, 0), "<u8", data, strides=(1,))
        out = np.empty(len(self.starts), np.uint64)
        for i in range(0, len(out), CHUNK):
            at, size = self.starts[i : i + CHUNK], self.ends[i : i + CHUNK] - self.starts[i : i + CHUNK]
            h = mix((lanes[at] & _FILLED[np.minimum(size, 8)]) * MULT[50] + size.astype(np.uint64) * MULT[51])
            some = np.flatnonzero(size > 8)
            for k in range(8, 8 * LANES, 8):
                some = some[size[some] > k]
                if not len(some):
                    break
                lane = lanes[at[some] + k] & _FILLED[np.minimum(size[some] - k, 8)]
                h[some] = mix((h[some] ^ lane) * MULT[52] + MULT[53])
            for j in np.flatnonzero(size > 8 * LANES):
                h[j] = int.from_bytes(hashlib.blake2b(data[at[j] : at[j] + size[j]].tobytes(), digest_size=8).digest(), "little")
            out[i : i + CHUNK] = h
        return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k neighbouring hashes, whatever row they are of."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * MULT[0]
    for j in range(1, k):
        out += h[j : j + n] * MULT[j]
    return mix(out)


def _pair(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    """One hash of each two, mixed between them."""
    out = a * MULT[54 + 2 * (turn % 4)]
    out ^= out >> np.uint64(29)
    out += b
    out *= MULT[55 + 2 * (turn % 4)]
    out ^= out >> np.uint64(32)
    return out


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """As ``grams`` for a large k: runs of 1, 2, 4, ... words are joined to runs of k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = CHUNK
    for i in range(0, n, step):
        m = min(step, n - i)
        part = h[i : i + m + k - 1]
        whole, done, size, turn = None, 0, 1, 0
        while True:
            if k & size:
                own = part[done : done + m] if whole is None else _pair(whole, part[done : done + m], turn + 1)
                whole, done = own, done + size
            if size * 2 > k:
                break
            part = _pair(part[:-size], part[size:], turn)
            size, turn = size * 2, turn + 1
        out[i : i + m] = whole
    return mix(out)


def long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())
