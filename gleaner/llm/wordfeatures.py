"""Hashed features of words, in numpy."""

from __future__ import annotations

import numpy as np

from .units import LOWER, U, Hasher, mix, ranges


def lowered(raw: np.ndarray) -> np.ndarray:
    """UTF-8 with A-Z and the capitals of Latin-1 lowered."""
    low = LOWER[raw]
    if len(low) > 1:
        second = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][second] += 32
    return low


def _numbers(h: Hasher, prefix: np.ndarray, kind: int, a: np.ndarray, b: np.ndarray, dim: int) -> np.ndarray:
    return (mix(h.span(prefix, a, b) + U(kind * 0x9E3779B97F4A7C15 % (1 << 64))) % U(dim)).astype(np.int64)


def word_features(h: Hasher, prefix: np.ndarray, a: np.ndarray, b: np.ndarray, dim: int, heads, tails, gram: int = 0, grams: int = 0) -> np.ndarray:
    """One row of feature numbers below dim for each word [a, b): the word itself, its first and last bytes, and its
    first n-grams; later_grams has the others. What a word is too short for is dim."""
    n = b - a

    def column(kind: int, x: np.ndarray, y: np.ndarray, there: np.ndarray) -> np.ndarray:
        return np.where(there, _numbers(h, prefix, kind, np.where(there, x, a), np.where(there, y, b), dim), dim)

    out = [column(1, a, b, n > 0)]
    out += [column(10 + k, a, a + k, n > k) for k in heads]
    out += [column(30 + k, b - k, b, n > k) for k in tails]
    out += [column(50, a + j, a + j + gram, n >= j + gram) for j in range(grams)]
    return np.stack(out, axis=1)


def later_grams(h: Hasher, prefix: np.ndarray, a: np.ndarray, b: np.ndarray, dim: int, gram: int, grams: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature number) of all n-grams of the words after the first `grams`."""
    more = np.maximum(b - a - gram + 1 - grams, 0)
    at = np.repeat(a + grams, more) + ranges(more)
    return np.repeat(np.arange(len(a)), more), _numbers(h, prefix, 50, at, at + gram, dim)
