"""Vectorised work on the byte buffers of Arrow string columns.

Texts are cut into words, hashed and windowed as whole numpy arrays, so the cost of a word is
a few array operations and not a Python call.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in runs of about so many bytes; a longer text makes a run of its own.
SLICE_BYTES = 512 << 10

#: Odd bases of polynomials modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

_U = np.uint64


def gap_table(word_bytes: bytes) -> np.ndarray:
    """For each byte value, whether it separates words."""
    table = np.ones(256, bool)
    table[np.frombuffer(word_bytes, np.uint8)] = False
    return table


#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and return.
WHITE = gap_table(bytes(b for b in range(256) if b not in (0x20, *range(0x09, 0x0E))))

#: Bytes with A to Z as a to z.
ASCII_LOWER = np.frombuffer(bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)), np.uint8)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most ``limit`` bytes each, or one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the first word of each row; no word crosses a row."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    gap = gaps[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, gap[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = True
    word = ~gap
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class _Powers:
    """Powers of a base and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.each = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            grow = [np.full(n, x, _U) for x in self.each]
            for a in grow:
                a[0] = 1
            self.up, self.down = (np.multiply.accumulate(a) for a in grow)
        return self.up[:n], self.down[:n]


_powers = [_Powers(b) for b in _BASES]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(29)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(32)
    return x


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0) -> np.ndarray:
    """Rabin-Karp hash modulo 2**64 of ``values[start:end]`` for each pair, then mixed.

    One running polynomial over all values gives each run by a difference and a shift, so the
    cost does not depend on the length of the runs.
    """
    n = len(values)
    up, down = _powers[base].get(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(values * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


#: Places of a word whose bytes have random numbers of their own.
_PLACES = 64


@functools.cache
def _salt(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, _PLACES * 256, _U)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, none of them empty, that is the same in every process.

    A word's hash is the sum of the random numbers of its bytes at their places, so no pattern
    of bytes makes two words meet, as some do under powers of any base.
    """
    if not len(starts):
        return np.zeros(0, _U)
    n = ends - starts
    total = np.cumsum(n)
    place = np.arange(int(total[-1])) - np.repeat(total - n, n)
    own = data[place + np.repeat(starts, n)]
    value = _salt(seed)[place % _PLACES * 256 + own]
    if int(n.max()) > _PLACES:
        far = np.flatnonzero(place >= _PLACES)
        value[far] = mix(value[far] + (place[far] // _PLACES).astype(_U) * _U(_BASES[0]))
    return mix(np.add.reduceat(value, total - n))


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Marks of the ``n`` positions that lie in ``[start, start + length)`` for some start."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:-1]) > 0


def intervals(mask: np.ndarray) -> np.ndarray:
    """Maximal runs of True as rows of (start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge.reshape(-1, 2)
