"""Order of suffixes and their common prefixes, by prefix doubling in numpy."""

from __future__ import annotations

import numpy as np


class Ranks:
    """Suffixes of several sequences that lie one after the other. end: for each symbol the end of its sequence.

    levels[k] numbers the first 2**k symbols of each suffix in their order; a suffix that ends before is less than those that go on.
    The last level orders by `deep` symbols at least, or wholly."""

    def __init__(self, symbols: np.ndarray, end: np.ndarray, deep: int):
        self.end = end
        n = len(symbols)
        rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.levels = [rank]
        classes, step = int(rank.max()) + 1 if n else 0, 1
        while step < deep:
            after = np.zeros(n, dtype=np.int64)
            there = np.flatnonzero(np.arange(step, n) < end[: n - step]) if step < n else np.zeros(0, dtype=np.int64)
            after[there] = rank[there + step] + 1
            rank = np.unique(rank * np.int64(classes + 1) + after, return_inverse=True)[1].astype(np.int64)
            self.levels.append(rank)
            now = int(rank.max()) + 1 if n else 0
            step *= 2
            if now == classes:  # longer prefixes tell no more apart
                break
            classes = now
        self.rank = rank
        self.wholly = step < deep

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at i and j, different places: right below `deep`, else that or more."""
        out = np.zeros(len(i), dtype=np.int64)
        rest = np.minimum(self.end[i] - i, self.end[j] - j)
        for k in range(len(self.levels) - 1, -1, -1):
            live = np.flatnonzero(out < rest)
            same = live[self.levels[k][i[live] + out[live]] == self.levels[k][j[live] + out[live]]]
            if self.wholly and k == len(self.levels) - 1:
                out[same] = rest[same]
            else:
                out[same] = np.minimum(out[same] + (1 << k), rest[same])
        return out


def byte_ranks(raw: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The suffixes of several byte sequences, each cut at its end, numbered in their order; equal ones alike."""
    n, step = len(raw), 7
    if not n:
        return np.zeros(0, dtype=np.int64)
    x, place = raw.astype(np.int64) + 1, np.arange(n)
    key = np.zeros(n, dtype=np.int64)
    for j in range(step):
        key *= 257
        key[: n - j] += np.where(place[j:] < end[: n - j], x[j:], 0) if j < n else 0
    classes, most = 0, int((end - place).max())
    while True:
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        now = int(rank.max()) + 1
        if now == classes or step >= most:
            return rank
        classes, after = now, np.zeros(n, dtype=np.int64)
        there = np.flatnonzero(place[step:] < end[: n - step])
        after[there] = rank[there + step] + 1
        key = rank * np.int64(classes + 1) + after
        step *= 2


def deep_nodes(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The uppermost inner nodes, `depth` symbols deep or more, of the suffix tree (as intervals of its suffix array).

    common: of each suffix with the one before it in order, 0 for the first. Returns each node's first leaf, end and depth."""
    inside = np.r_[common >= depth, False]
    inside[:1] = False
    edge = np.flatnonzero(np.diff(np.r_[False, inside].astype(np.int8)))
    first, end = edge[::2], edge[1::2]
    low = np.minimum.reduceat(np.r_[common, 0], np.stack([first, end], axis=1).ravel())[::2] if len(first) else np.zeros(0, dtype=np.int64)
    return first - 1, end, low
