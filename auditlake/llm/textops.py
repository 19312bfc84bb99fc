"""Vectorised word splitting and hashing over Arrow text columns.

Words are maximal runs of bytes other than space, tab, LF, VT, FF and CR. Hashes are polynomials modulo 2**64, taken
from prefix sums (the base is odd, so a prefix can be shifted out), and mixed; equal words have equal hashes in every
process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_powers: dict[int, np.ndarray] = {}
_BLOCK = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; up to a block of them is kept between calls."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, _BLOCK), base, np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if n <= _BLOCK:
            _powers[base] = known
    return known[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = _BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def split(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SEPARATORS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each row's first word (n + 1 entries)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, made over blocks of bounded size."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * powers(_BYTE_BASE, hi - lo), out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * powers(inverse(_BYTE_BASE), hi - lo)[s] + (e - s).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        i = j
    return mix(out)


def rolling(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A hash of every n consecutive entries (those that cross rows too; see ``fits``)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    if len(hashes) > _BLOCK + n:  # by blocks that overlap in n - 1 entries
        return np.concatenate([rolling(hashes[i : i + _BLOCK + n - 1], n, salt) for i in range(0, len(hashes) - n + 1, _BLOCK)])
    if salt:
        hashes = mix(hashes ^ np.uint64(salt))
    sums = np.empty(len(hashes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(hashes * powers(_WORD_BASE, len(hashes)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(inverse(_WORD_BASE), len(hashes) - n + 1))


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def fits(first: np.ndarray, n: int) -> np.ndarray:
    """For each of the ``rolling`` windows: does it stay within one row?"""
    words = int(first[-1])
    if words < n:
        return np.zeros(0, bool)
    end = np.repeat(first[1:], np.diff(first))[: words - n + 1]
    return np.arange(n, words + 1) <= end
