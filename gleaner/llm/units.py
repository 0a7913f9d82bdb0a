"""Words and rolling hashes of many texts at once, over UTF-8 bytes in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that a task takes apart at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finisher that spreads 64 bits (splitmix64)."""
    x = np.asarray(x, dtype=U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _class(inside) -> np.ndarray:
    return np.array([inside(b) for b in range(256)], dtype=bool)


#: Bytes of words that ASCII blanks part, and of words of digits, letters and all else beyond ASCII.
NOT_BLANK = _class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
ALNUM = _class(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
LETTER = _class(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


class Hasher:
    """Polynomial hashes modulo 2**64 of any span in constant time."""

    def __init__(self, seed: int = 1):
        self.base = U(mix(np.array([seed], dtype=U))[0] | U(1))
        self.inverse = U(pow(int(self.base), -1, 1 << 64))
        self.of_byte = mix(np.arange(256, dtype=U) + U((seed * 0x9E3779B97F4A7C15) % (1 << 64)))
        self.up = self.down = np.ones(1, dtype=U)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", self.inverse)):
                    x = np.full(n, b, dtype=U)
                    x[0] = U(1)
                    setattr(self, name, np.cumprod(x, dtype=U))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=U)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of values[a:b]; equal spans have equal hashes wherever they lie."""
        n = (b - a).astype(U) if isinstance(b, np.ndarray) else U(b - a)
        return mix((prefix[b] - prefix[a]) * self.down[a] + n * U(0xD6E8FEB86659FD93))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes and the offsets (n + 1) of the texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, off - off[0]


def give_back() -> None:
    """Hand freed memory back to the system: Spark keeps a task's Python process for later tasks, of whatever kind."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches with about `most` bytes of text each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = flat(batch.column(text))
        cuts = np.searchsorted(off, np.arange(0, off[-1] + 1, most)) if off[-1] > most else np.array([0])
        cuts = np.unique(np.append(cuts, batch.num_rows))
        cuts = cuts[cuts <= batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)
    give_back()


def words(raw: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes, ends, and each text's range (n + 1) among the words. A word never spans two texts."""
    n = len(raw)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(len(off), dtype=np.int64)
    w = inside[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    start = w.copy()
    start[1:] &= ~w[:-1] | edge[1:n]
    end = w.copy()
    end[:-1] &= ~w[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def joined(blobs: list[bytes], columns: int) -> np.ndarray:
    """Rows of `columns` unsigned 64-bit numbers from packed pieces."""
    return np.frombuffer(b"".join(blobs), dtype=U).reshape(-1, columns)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(bucket, blobs) for each run of equal buckets."""
    now, got = None, []
    for batch in batches:
        for k, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
            if k != now and got:
                yield now, got
                got = []
            now = k
            got.append(blob)
    if got:
        yield now, got


def packed(rows: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Rows (n x c, uint64) dealt by their first column."""
    k = (rows[:, 0] >> U(11)) % U(buckets)
    order = np.argsort(k, kind="stable")
    rows, k = rows[order], k[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else []
    for a, b in zip(at, [*at[1:], len(k)]):
        yield int(k[a]), rows[a:b].tobytes()
