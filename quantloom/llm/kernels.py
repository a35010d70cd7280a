"""Numpy helpers on the bytes of an Arrow batch: words, hashes of spans, and anchors.

Hashes of spans are differences of prefix sums of value * base**position, modulo 2**64, brought back to position 0 by
powers of the base's inverse, and mixed. Two bases and value tables give two independent hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
#: Longest stretch of units that is worked on at once; longer documents are cut into overlapping stretches.
STRETCH = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


@lru_cache(maxsize=4)
def byte_values(which: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(BASES[which]) + U(which + 1))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse: one table for each base, as long as the longest asked for."""
    if which not in _powers or len(_powers[which][0]) < n:
        out = []
        for base in (BASES[which], pow(BASES[which], -1, 1 << 64)):
            p = np.full(1 << max(12, int(n - 1).bit_length()), base, U)
            p[0] = 1
            np.cumprod(p, out=p)
            out.append(p)
        _powers[which] = (out[0], out[1])
    return _powers[which]


class Spans:
    """Hashes of spans [start, end) of a row of 64-bit values."""

    def __init__(self, values: np.ndarray, which: int):
        n = len(values)
        up, self.down = powers(which, n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * up[:n], out=self.sums[1:], dtype=U)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row begins and the last ends. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def words_at(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in data, and the number of words before each row."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):  # stretches of some bytes, so that the prefix sums stay small
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STRETCH)))
        lo, hi = starts[i], ends[j - 1]
        out[i:j] = Spans(byte_values(0)[data[lo:hi]], 0)(starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


def stretches(at: np.ndarray, window: int, size: int = STRETCH):
    """(first row, offsets of the rows or of a part of one row, offset of that part in its row): pieces of about `size` units.

    A row longer than that is cut into parts that overlap by window - 1 units, so that each window lies in one part.
    """
    i, rows = 0, len(at) - 1
    while i < rows:
        if at[i + 1] - at[i] > size:
            for lo in range(at[i], max(at[i] + 1, at[i + 1] - window + 1), size):
                yield i, np.array([lo, min(at[i + 1], lo + size + window - 1)]), lo - at[i]
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, at[i : j + 1], 0
        i = j


def starts_inside(at: np.ndarray, window: int) -> np.ndarray:
    """For each unit: does a window that starts there end inside the same row?"""
    n = at[-1] - at[0]
    steps = np.zeros(n + 1, np.int64)
    fits = np.diff(at) >= window
    np.add.at(steps, at[:-1][fits] - at[0], 1)
    np.add.at(steps, at[1:][fits] - at[0] - window + 1, -1)
    return np.cumsum(steps[:n]) > 0


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    return np.minimum(keys[: len(keys) - (width - have)], keys[width - have :]) if width > have else keys


def anchors(values: np.ndarray, at: np.ndarray, window: int, gram: int, with_whole: bool = True):
    """Of each window its anchor: the gram with the least hash inside it, the first of equals.

    Equal windows so have equal anchors at equal places. Windows in a row that share an anchor make one group. Returns arrays
    with an entry a group: first window's start, number of windows, place of the anchor, the gram's hash, and a hash of
    all the group covers.
    """
    n = len(values)
    if n < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
    h1 = Spans(values, 0)
    begin = np.arange(n - gram + 1)
    hashes = h1(begin, begin + gram)
    bits = U(max(1, int(n).bit_length()))
    keys = (hashes >> bits << bits) | begin.astype(U)
    chosen = (sliding_min(keys, window - gram + 1) & ((U(1) << bits) - U(1))).astype(np.int64)
    valid = np.flatnonzero(starts_inside(at, window)[: len(chosen)])
    if not len(valid):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
    place = chosen[valid]
    new = np.empty(len(valid), bool)
    new[0] = True
    new[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(valid)))
    start, place = valid[first], place[first]
    if not with_whole:
        return start, count, place, hashes[place], None
    whole = Spans(values, 1)(start, start + count - 1 + window)
    whole = mix(whole + (place - start).astype(U) * U(BASES[0]) + count.astype(U))
    return start, count, place, hashes[place], whole
