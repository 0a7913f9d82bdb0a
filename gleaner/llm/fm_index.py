"""FM-index over a sequence of symbols: wavelet-matrix ranks and sampled suffix positions, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64


class Bits:
    """A bit vector with ranks in constant time."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(U)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def __call__(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        low = (U(1) << (i & 63).astype(U)) - U(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, top: int):
        self.levels: list[tuple[int, Bits, int]] = []
        v = values
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (v >> shift) & 1
            self.levels.append((shift, Bits(bit), int(len(v) - bit.sum())))
            v = np.concatenate([v[bit == 0], v[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first i values."""
        start = np.zeros_like(i)
        for shift, ones, zeros in self.levels:
            up = ((symbol >> shift) & 1).astype(bool)
            a, b = ones(start), ones(i)
            start = np.where(up, zeros + a, start - a)
            i = np.where(up, zeros + b, i - b)
        return i - start


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Order of the suffixes of x, by prefix doubling. Zeros are separators:
    each differs from all others, and the earlier is less."""
    n = len(x)
    sep = x == 0
    m = int(sep.sum())
    rank = x.astype(np.int64) + m
    rank[sep] = np.arange(m)
    step, order = 1, np.argsort(rank, kind="stable")
    while True:
        after = np.zeros(n, dtype=np.int64)
        if step < n:
            after[: n - step] = rank[step:] + 1
        key = rank * np.int64(rank.max() + 2 if n else 1) + after
        order = np.argsort(key)
        k = key[order]
        new = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])]) if n else np.zeros(0, dtype=np.int64)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if not n or new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """x ends with a separator (0) after each segment; other symbols are 1..top."""

    def __init__(self, x: np.ndarray, top: int, sample: int = 8):
        self.n = len(x)
        sa = suffix_array(x)
        before = x[sa - 1]  # of position 0 the last separator
        self.last = before
        self.ranks = WaveletMatrix(before, top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=top + 1))])
        starts = before == 0
        kept = starts | (sa % sample == 0)
        self.sampled, self.at = Bits(kept), sa[kept]
        self.is_sampled = kept

    def _back(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.ranks.rank(symbol, i)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each phrase. phrases: right-aligned symbols; 0 stands for a symbol that the index lacks."""
        width = phrases.shape[1]
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        for t in range(width):
            live = np.flatnonzero((lengths > t) & (low < high))
            if not len(live):
                break
            c = phrases[live, width - 1 - t]
            low[live], high[live] = self._back(c, low[live]), self._back(c, high[live])
            gone = live[c == 0]
            low[gone] = high[gone] = 0
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in x of the suffixes at these rows."""
        out, steps = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        todo, rows = np.arange(len(rows)), rows.copy()
        while len(todo):
            r = rows[todo]
            hit = self.is_sampled[r]
            done = todo[hit]
            out[done] = self.at[self.sampled(r[hit])] + steps[done]
            todo = todo[~hit]
            r = r[~hit]
            rows[todo] = self._back(self.last[r], r)
            steps[todo] += 1
        return out
