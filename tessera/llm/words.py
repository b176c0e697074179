"""Words and shingles of many texts at once, as 64-bit hashes, in numpy over their UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of words: all but white space, and letters and digits with all bytes beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_TABLE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _BASE, np.uint64)]))


@dataclass
class Words:
    """Byte spans and hashes of the words, and where each row's words begin (one more than rows)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = NOT_SPACE, lower: bool = True) -> Words:
    inside = letters[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = before[-1] = False
    before[1:-1] = inside[:-1]
    before[offsets] = False  # no word goes on from one row into the next
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    lengths = ends - starts
    if len(starts):
        letters_in = data[inside]
        at = np.cumsum(lengths) - lengths
        place = np.arange(len(letters_in)) - np.repeat(at, lengths)
        parts = _TABLE[_LOWER[letters_in] if lower else letters_in] * _powers(int(lengths.max()))[place]
        hashes = mix(np.add.reduceat(parts, at) + lengths.astype(np.uint64))
    else:
        hashes = np.empty(0, np.uint64)
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words, row by row, and where each row's begin. A row with fewer words, but not none, has one run of them all."""
    count = np.diff(w.rows)
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    rows = np.concatenate([[0], np.cumsum(runs)])
    first = np.repeat(w.rows[:-1], runs) + np.arange(rows[-1]) - np.repeat(rows[:-1], runs)
    left = np.minimum(np.repeat(count, runs), n)
    out = np.zeros(int(rows[-1]), np.uint64)
    for k, power in enumerate(_powers(n + 1)[1:]):
        if len(first):
            part = w.hashes[np.minimum(first + k, len(w.hashes) - 1)] * power
            out += part if k == 0 else np.where(left > k, part, np.uint64(0))
    return mix(out + left.astype(np.uint64)), rows


def distinct_sets(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's hashes sorted and without repeats, and where each row's begin."""
    out = hashes.copy()
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        out[a:b].sort()
    first = np.ones(len(out), bool)
    first[1:] = out[1:] != out[:-1]
    first[rows[:-1][np.diff(rows) > 0]] = True
    kept = np.concatenate([[0], np.cumsum(first)])[rows]
    return out[first], kept
