"""Vectorised work on the words of many texts at once, straight on Arrow's buffers.

A word is a run of bytes outside 0x20 and 0x09-0x0D, as the contracts define it. Hashes are 64 bits:
a polynomial over the word's bytes from prefix sums, then a finaliser.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
#: Bytes of text worked on at once; the arrays below take about 60 times as much.
SLICE = 1 << 19


#: What a worker keeps from task to task (a tokenizer and its words).
KEPT: dict[object, object] = {}


def tidy() -> None:
    """At the start of a task that needs nothing kept: a worker serves one operator after another, and memory that one has freed
    or only keeps for later would count against the next."""
    KEPT.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


@lru_cache(maxsize=2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE, U), np.full(size, BASE_INVERSE, U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = SLICE * 2
    while size < n + 1:
        size *= 2
    return powers(size)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        column = column.cast(pa.large_binary())
        kind = np.int64
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:  # a null may have bytes below it
        size = np.where(np.asarray(column.is_valid()), np.diff(off), 0)
        if (size != np.diff(off)).any():
            parts = [raw[a : a + s] for a, s in zip(off[:-1], size)]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum(size)])
    return raw[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes; a longer text stands alone."""
    data, off = buffers(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, min(n, int(np.searchsorted(off, off[a] + limit, "right")) - 1))
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def word_bounds(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of bytes outside ``space``), and each text's first word (one more entry than texts)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(space[data], out=inside[1:-1])
    before, after = inside[:-2].copy(), inside[2:].copy()
    before[off[:-1][off[:-1] < n]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside[1:-1] & ~before)
    ends = np.flatnonzero(inside[1:-1] & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    up, down = power_tables(len(data))
    prefix = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k entries (those that cross texts are for the caller to leave out)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(n, U)
    for j in range(k):
        total *= U(0xA0761D6478BD642F)
        total += hashes[j : j + n]
    return mix(total + U(k))


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingles, A-Z lower-cased; a text of fewer words has one, its whole sequence."""
    low = LOWER[data]
    starts, ends, first = word_bounds(low, off)
    words = span_hashes(low, starts, ends)
    runs = window_hashes(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            s = np.sort(runs[a : b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            out.append(window_hashes(words[a:b], b - a))
        else:
            out.append(np.zeros(0, U))
    return out
