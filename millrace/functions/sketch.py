"""Sketches of sets of 64-bit hashes, and their bands.

Fast similarity sketching (Dahlgaard, Knudsen and Thorup, FOCS 2017): in round i < t every
element is hashed to one of t bins with the value (i, hash) and a bin keeps its least value; rounds go
on only while a bin is empty. Rounds t .. 2t-1 send all elements to bin i - t, so that every coordinate
fills for any non-empty set. Two sets agree in a coordinate with probability J, and the estimate is
concentrated as for t independent hash functions, at O(n + t log t) instead of O(n t).
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


def sketch(shingles: np.ndarray, t: int) -> np.ndarray:
    """The t coordinates, as round << 40 | 40 bits of the hash. ``shingles``: distinct, not empty."""
    if t > 256:
        raise ValueError("a sketch has at most 256 coordinates")
    n = len(shingles)
    out, empty = np.zeros(t, U), np.ones(t, bool)
    begin, block = 0, max(2, -(-8 * t // n)) if n < 4 * t else 1
    while begin < t:
        rounds = np.arange(begin, min(t, begin + block), dtype=U)
        h = mix(shingles[None, :] ^ mix(rounds * U(0x9E3779B97F4A7C15) + U(77))[:, None])
        bins = ((h >> U(40)) * U(t)) >> U(24)
        value = (rounds[:, None] << U(40)) | (h & U((1 << 40) - 1))
        key = np.sort(((bins << U(56)) | value).ravel())
        at = (key >> U(56)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        take = first[empty[at[first]]]
        out[at[take]] = key[take] & U((1 << 56) - 1)
        empty[at[take]] = False
        if not empty.any():
            return out
        begin, block = begin + len(rounds), max(1, min(64, -(-2 * t // n)))
    for b in np.flatnonzero(empty).tolist():  # rounds t .. 2t-1: all shingles go to bin i - t
        h = mix(shingles ^ mix(np.array([(t + b) * 0x9E3779B97F4A7C15 + 77 & (1 << 64) - 1], U))[0])
        out[b] = U((t + b) << 40) | (h & U((1 << 40) - 1)).min()
    return out


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    total = mix(np.arange(1, bands + 1, dtype=U) * U(0xE7037ED1A0B428DB))
    for j in range(rows):
        total = mix(total * U(0xA0761D6478BD642F) + coordinates[j::rows][:bands])
    return total.view(np.int64)
