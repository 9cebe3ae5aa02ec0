"""Hashes of words and word shingles of one text, computed on whole arrays."""

from __future__ import annotations

import numpy as np

#: Longest stretch hashed at once; longer texts are cut at a separator.
STRETCH = 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            row = np.full(1 << (n - 1).bit_length(), base, np.uint64)
            row[0] = 1
            _powers[i] = np.cumprod(row, dtype=np.uint64)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def word_hashes(data: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word of UTF-8 bytes, in order; A-Z count as a-z."""
    if len(data) > STRETCH:
        cuts = np.flatnonzero(_SEPARATOR[data[: len(data) // 2]])
        if not len(cuts):
            cuts = np.flatnonzero(_SEPARATOR[data[len(data) // 2 :]])[:1] + len(data) // 2
        if len(cuts):
            return np.concatenate([word_hashes(data[: cuts[-1]]), word_hashes(data[cuts[-1] + 1 :])])
    gap = np.ones(len(data) + 2, np.int8)
    gap[1:-1] = _SEPARATOR[data]
    edges = np.diff(gap)
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``length`` words; shorter texts are one run, none is empty."""
    if not len(words):
        return words
    n = max(len(words) - length + 1, 1)
    total = words[:n].copy()
    for i in range(1, min(length, len(words))):
        total *= _BASE
        total ^= total >> np.uint64(29)
        total += words[i : i + n]
    return distinct(mixed(total))
