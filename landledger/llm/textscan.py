"""Words of many texts at once: positions and 64-bit hashes over the texts' UTF-8 bytes, in numpy.

A multi-byte character is never cut: all its bytes are at least 0x80 and count as word bytes in both word classes.
"""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Words `[^\x20\x09-\x0D]+`.
SOLID = np.ones(256, bool)
SOLID[[0x20, 9, 10, 11, 12, 13]] = False

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes whose sums are held at once.
HASHED_BYTES = 1 << 19
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            _powers[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]), dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def word_spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the number of words before it (one more entry than rows)."""
    inside = table[raw]
    filled = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begin, end = inside.copy(), inside.copy()
    if len(raw):
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        begin[first], end[last] = inside[first], inside[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and apart. Works on about HASHED_BYTES at a time."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, base + HASHED_BYTES, "right")))
        part = raw[base : int(ends[stop - 1])]
        up, down = _power(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        first, last = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = (sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)
        at = stop
    return mix(out)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` consecutive words of each row, and row bounds; a row of fewer words, but not none, has one."""
    counts = np.diff(bounds)
    made = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    at = np.concatenate([[0], np.cumsum(made)])
    index = np.arange(at[-1]) - np.repeat(at[:-1], made) + np.repeat(bounds[:-1], made)
    left = np.repeat(bounds[1:], made) - index
    total = np.zeros(len(index), np.uint64)
    for k in range(size):
        there = left > k
        term = words[np.minimum(index + k, max(len(words) - 1, 0))] if len(words) else total
        total = np.where(there, mix(total) + term * np.uint64(2 * k + 1), total)
    return mix(total), at
