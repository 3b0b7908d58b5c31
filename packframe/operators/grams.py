"""Shared n-grams of pairs of sequences, a batch of rows in a few sorts.

A gram is known by a 64-bit hash of its items and its row, so two grams of a row
are taken for one with a chance of 1 in 10**19.
"""

from __future__ import annotations

import numpy as np

_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def _keys(items: np.ndarray, offsets: np.ndarray, most: int):
    """For each n from 1 to most, the hashes of all n-grams that lie within a row."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(items))
    left = offsets[1:][row] - at
    key = _mixed(row.astype(np.uint64) * _C + np.uint64(1))
    codes = items.astype(np.uint64) + np.uint64(1)
    for n in range(1, most + 1):
        fits = left >= n
        key, left, at = key[fits], left[fits], at[fits]
        key = _mixed(key * _C + codes[at + n - 1])
        yield key


def shared(a: np.ndarray, a_offsets: np.ndarray, b: np.ndarray, b_offsets: np.ndarray, most: int) -> np.ndarray:
    """(most, 3): the grams of a, those of b, and those they share (as often as the side that has fewer), summed over rows."""
    out = np.zeros((most, 3), np.int64)
    for n, (x, y) in enumerate(zip(_keys(a, a_offsets, most), _keys(b, b_offsets, most))):
        x_keys, x_counts = np.unique(x, return_counts=True)
        y_keys, y_counts = np.unique(y, return_counts=True)
        _, i, j = np.intersect1d(x_keys, y_keys, assume_unique=True, return_indices=True)
        out[n] = len(x), len(y), np.minimum(x_counts[i], y_counts[j]).sum()
    return out
