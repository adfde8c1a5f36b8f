"""Vectorised words of Arrow text batches, for use inside tasks.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased; each
has a 64-bit hash. Work goes by sub-batches of a few MB, whatever the row count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 3
SUB_BATCH = 1 << 20

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_word = np.ones(256, bool)
_word[[9, 10, 11, 12, 13, 32]] = False
#: Letters, digits and all bytes beyond ASCII: words without punctuation.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x is uint64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_table = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            x = np.full(n, base & ((1 << 64) - 1), U)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=U)
    return _powers["up"], _powers["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


class Words:
    """Words of rows lo..hi of a batch: starts and ends in ``data``, hashes, and the first word of each row."""

    def __init__(self, lo: int, hi: int, offsets: np.ndarray, data: np.ndarray, kind: np.ndarray = _word):
        self.lo, self.hi = lo, hi
        self.offsets = offsets[lo : hi + 1] - offsets[lo]
        self.data = _lower[data[offsets[lo] : offsets[hi]]]
        n = len(self.data)
        word = kind[self.data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        begins, ends = self.offsets[:-1], self.offsets[1:]
        before[begins[begins < n]] = False
        after[ends[ends > 0] - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            n = len(self.data)
            up, down = _grow(n + 1)
            sums = np.zeros(n + 1, U)
            np.cumsum(_table[self.data] * up[:n], out=sums[1:])
            self._hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(U))
        return self._hashes

    def rows(self) -> np.ndarray:
        """The row of each word, counted from lo."""
        return np.repeat(np.arange(self.hi - self.lo), self.counts)


def sub_batches(column: pa.Array, most_rows: int = 4096, kind: np.ndarray = _word) -> Iterator[Words]:
    """Rows in order, cut after SUB_BATCH bytes or most_rows rows; a row is never cut."""
    offsets, data = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + SUB_BATCH, side="right")) - 1
        hi = min(n, max(lo + 1, min(hi, lo + most_rows)))
        yield Words(lo, hi, offsets, data, kind)
        lo = hi


def shingle_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of k words; a row with fewer words is one shingle, a row without words none."""
    h, first, counts = words.hashes, words.first, words.counts
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    rolled = np.zeros(n, U)
    for i in range(k):
        rolled[: n - i] += mix(h[i:] + U(i + 1)) * U(2 * i + 0x9E37_79B1)
    rows = words.rows()
    left = first[1:][rows] - np.arange(n)  # words of the row from here on
    whole = left >= k
    short = np.flatnonzero((counts < k) & (counts > 0))
    hashes, at = mix(rolled[whole]), rows[whole]
    if len(short):
        own = np.array([_sequence(h[first[r] : first[r + 1]]) for r in short], U)
        hashes, at = np.concatenate([hashes, own]), np.concatenate([at, short])
    return at, hashes


def _sequence(h: np.ndarray) -> int:
    x = int(len(h)) * 0x5851F42D4C957F2D & (1 << 64) - 1
    for v in h:
        x = (x * 0x5851F42D4C957F2D + int(v)) & (1 << 64) - 1
        x ^= x >> 29
    return x
