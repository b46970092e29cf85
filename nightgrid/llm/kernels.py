"""Vectorised text kernels on Arrow buffers: words, rolling hashes, sliding minima.

A batch of texts is handled as one byte array; rows are told apart by masks, so there is no Python
loop over documents in the hot paths. Hashes are 64-bit polynomial sums (mod 2**64) of random byte
or word values, finished by a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are worked on at once; bounds a worker's memory whatever the batch.
SLICE_BYTES = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
MULT_A, MULT_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit values."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


@lru_cache(maxsize=4)
def byte_values(lower: bool = False) -> np.ndarray:
    """A random 64-bit value for each byte; with ``lower``, A-Z count as a-z."""
    v = mix64(np.arange(1, 257, dtype=np.uint64) * U(0xA0761D6478BD642F))
    return v[_LOWER] if lower else v


@lru_cache(maxsize=4)
def _powers(mult: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = pow(mult, -1, 1 << 64)
    out = []
    for m in (mult, inv):
        p = np.full(n, m, np.uint64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        out.append(p)
    return out[0], out[1]


def powers(mult: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``mult`` and of its inverse; computed for a rounded-up size and sliced."""
    size = 1 << max(16, int(n - 1).bit_length())
    if size > 1 << 23:  # a single text beyond the slice size: not worth keeping
        a, b = _powers.__wrapped__(mult, n)
    else:
        a, b = _powers(mult, size)
    return a[:n], b[:n]


class RollingHash:
    """Hash of any range of a value sequence in O(1) after one pass."""

    def __init__(self, values: np.ndarray, mult: int = MULT_A):
        n = len(values)
        p, self.inv = powers(mult, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * p[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(np.uint64))

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all windows of ``k`` values."""
        n = len(self.sums) - 1
        if n < k:
            return np.empty(0, np.uint64)
        return mix64((self.sums[k:] - self.sums[: n - k + 1]) * self.inv[: n - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w`` values, by doubling."""
    if len(x) < w:
        return x[:0]
    s, a = 1, x
    while 2 * s <= w:
        a = np.minimum(a[:-s], a[s:])
        s *= 2
    return np.minimum(a[: len(x) - w + 1], a[w - s :][: len(x) - w + 1]) if s < w else a


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its n+1 offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = np.int64 if col.type in (pa.large_string(), pa.large_binary()) else np.int32
    _, offs, data = col.buffers()
    n = len(col)
    o = np.frombuffer(offs, wide)[col.offset : col.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return buf[o[0] : o[-1]], o - o[0]


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes, one row at least."""
    buf, o = flat(col)
    n, i = len(o) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + limit, "right")) - 1)
        yield i, j, buf[o[i] : o[j]], o[i : j + 1] - o[i]
        i = j


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a run of texts: byte ranges, and the first word of each text."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        solid = ~_SPACE[buf]
        n = len(buf)
        before = np.ones(n + 1, bool)  # position follows a space or starts a text
        np.logical_not(solid, out=before[1:])
        before[offs] = True
        self.start = np.flatnonzero(solid & before[:n])
        after = np.ones(n + 1, bool)
        after[:n] = ~solid
        after[offs] = True
        self.end = np.flatnonzero(solid & after[1:]) + 1
        self.first = np.searchsorted(self.start, offs)  # n+1: words [first[i], first[i+1]) are text i's
        self.buf = buf

    def hashes(self, lower: bool = False) -> np.ndarray:
        if not len(self.start):
            return np.empty(0, np.uint64)
        return RollingHash(byte_values(lower)[self.buf]).ranges(self.start, self.end)

    def text(self, i: int) -> np.ndarray:
        """Row index of each word (i unused rows have none)."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def signed(x: np.ndarray) -> np.ndarray:
    """As Spark's LongType has it."""
    return x.view(np.int64)


def ranges_concat(lo: np.ndarray, length: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, .. for each range, one after another."""
    total = int(length.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) - np.repeat(ends - length, length) + np.repeat(lo, length)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges as maximal disjoint ranges (touching ones join)."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:], len(s)) - 1]
