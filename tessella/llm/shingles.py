"""Word shingles of texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .util import hashes, mix64

_STEP = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ (A-Z in lower case) of the texts in data, and each text's number of words before it."""
    low = np.where((data >= 65) & (data <= 90), data | np.uint8(32), data)
    black = (low != 32) & ((low < 9) | (low > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(black & (edge[:-1] | ~np.concatenate([[False], black[:-1]])))
    end = np.flatnonzero(black & (edge[1:] | ~np.concatenate([black[1:], [False]]))) + 1
    return hashes(low, start, end), np.searchsorted(start, offsets)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Each text's set, sorted: its distinct n-word shingles; all words as one if they are fewer; empty without words."""
    h, first = words(offsets, data)
    run = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        run += h[k : k + len(run)] * _STEP[k % 5] * np.uint64(2 * (k // 5) + 1)
    run = mix64(run)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            x = run[a : b - n + 1].copy()
            x.sort()
            if len(x) > 1:
                x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif b > a:
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = mix64(x * _STEP[0] + h[k])
        else:
            x = np.zeros(0, np.uint64)
        out.append(x)
    return out
