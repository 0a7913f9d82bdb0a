"""Jaccard join of word n-gram sets by PartEnum signatures.

Two sets at the threshold differ in at most k elements, k following from their
sizes. For sizes of one band (or two that touch), the element domain is split
by hash into n1 parts of n2 pieces; of the parts, more than n1 - k / (k2 + 1)
hold at most k2 differences, and there some choice of n2 - k2 pieces holds
none. So each set emits, for every part and every such choice of pieces, a
signature of its elements there, and linked sets share one. Shared signatures
are then checked against the sets themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packedsteps
from .components import components
from .store import materialize, release, small_batches
from .textsql import word_count
from .units import LOWER, NOT_BLANK, U, Hasher, by_bucket, flat, mix, ranges, slices, words

#: Members of a star that are tried in one run.
STAR = 2000
FLUSH = 1 << 20


class Bands:
    """Sizes in bands of ratio 1/threshold, and each band's partition."""

    def __init__(self, percent: int):
        self.percent = percent
        self.bands: list[tuple[int, int]] = []

    def of(self, sizes: np.ndarray) -> np.ndarray:
        top = int(sizes.max()) if len(sizes) else 1
        while not self.bands or self.bands[-1][1] < top:
            low = self.bands[-1][1] + 1 if self.bands else 1
            self.bands.append((low, max(low, low * 100 // self.percent)))
        return np.searchsorted(np.array([b[0] for b in self.bands]), sizes, side="right") - 1

    def most(self, total: int) -> int:
        """Differences that sets of `total` elements together may have."""
        return (100 - self.percent) * total // (100 + self.percent)

    def instance(self, i: int) -> tuple[int, int]:
        """Of bands i - 1 and i: differences that two sets may have, least size."""
        return self.most(2 * self.bands[i][1]), self.bands[max(0, i - 1)][0]


def layout(k: int, least: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, spare): parts, pieces, differences borne within a part, and
    parts beyond those that the differences can spoil, less one.

    Of the layouts whose signatures cover five elements or more, one with the most
    spare parts, then the fewest signatures; else the one whose signatures cover the most. Where signatures cover enough, so many more parts are
    spare that the parts with a signature over nothing, of which there are some among very many, are made up for and sets must still share several.
    """
    found = []
    for k2 in (1, 2):
        for n2 in range(k2 + 1, k2 + 4):
            for spare in (2, 1, 0):
                n1 = k // (k2 + 1) + 1 + spare
                each = least / n1 * (n2 - k2) / n2
                found.append((each < 5, -spare if each >= 5 else 0, n1 * comb(n2, k2) if each >= 5 else -each, n1, n2, k2, spare))
    few, *_, n1, n2, k2, spare = min(found)
    each = least / n1 * (n2 - k2) / n2
    more = spare + int(np.ceil(2 * n1 * comb(n2, k2) * np.exp(-each)))
    if not few and least / (n1 + more - spare) * (n2 - k2) / n2 >= 4:
        n1, spare = n1 + more - spare, more
    return n1, n2, k2, spare


def signatures(elements: np.ndarray, sizes: np.ndarray, bands: Bands, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set index, signature) of all sets; and for each set how many signatures it shares at least with any that it is linked to. elements: the sets' distinct hashes, one set after the other.

    A signature over pieces that hold no element is dropped where the set has
    no more such parts than are spare: linked sets agree on one more part than that.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    band = bands.of(sizes)
    need = np.full(len(sizes), 1 << 20)
    who: list[np.ndarray] = []
    sigs: list[np.ndarray] = []
    bands.of(np.array([bands.bands[-1][1] + 1]))
    for side in (0, 1):  # with its own band and the one before; with the next
        inst = band + side
        for i in np.unique(inst):
            mine = np.flatnonzero((inst == i) & (sizes > 0))
            if not len(mine):
                continue
            k, least = bands.instance(int(i))
            if k == 0:
                continue  # only equal sets, which are one set here
            n1, n2, k2, spare = layout(k, least)
            n = sizes[mine]
            at = np.repeat(first[mine], n) + ranges(n)
            x = mix(elements[at] ^ U((int(i) * 0x9E3779B97F4A7C15 + seed * 0xC2B2AE3D27D4EB4F + 7) % (1 << 64)))
            cell = (x % U(n1 * n2)).astype(np.int64) + np.repeat(np.arange(len(mine)) * (n1 * n2), n)
            total = np.zeros(len(mine) * n1 * n2, dtype=U)
            np.add.at(total, cell, mix(x + U(1)))
            count = np.bincount(cell, minlength=len(total)).reshape(len(mine), n1, n2)
            total = total.reshape(len(mine), n1, n2)
            chosen = list(combinations(range(n2), n2 - k2))
            sums = np.stack([total[:, :, c].sum(axis=2, dtype=U) for c in map(list, chosen)], axis=2)
            full = np.stack([count[:, :, c].sum(axis=2) > 0 for c in map(list, chosen)], axis=2)
            weak = (~full).any(axis=2).sum(axis=1)
            keep = full | (weak > spare)[:, None, None]
            # Linked sets agree in 1 + spare parts; what they agree on may hold nothing only in parts weak in both.
            need[mine] = np.minimum(need[mine], np.maximum(1, 1 + spare - weak))
            tag = np.arange(n1 * len(chosen), dtype=U).reshape(n1, len(chosen)) + U(int(i) << 32) + U(seed << 60)
            out = mix(sums + mix(tag)[None, :, :])
            rows = np.broadcast_to(mine[:, None, None], out.shape)
            who.append(rows[keep])
            sigs.append(out[keep])
    if not who:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U), need
    return np.concatenate(who), np.concatenate(sigs), need


class Sets:
    """Distinct n-gram hashes of each text; a shorter text's words are one n-gram."""

    def __init__(self, gram: int):
        self.gram, self.bytes, self.units = gram, Hasher(11), Hasher(12)

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        raw, off = flat(column)
        low = LOWER[raw]
        a, b, at = words(raw, off, NOT_BLANK)
        w = self.bytes.span(self.bytes.prefix(self.bytes.of_byte[low]), a, b)
        p = self.units.prefix(w)
        n = len(w)
        g = self.units.span(p, np.arange(max(0, n - self.gram + 1)), np.arange(self.gram, n + 1)) if n >= self.gram else np.zeros(0, dtype=U)
        out = []
        for x, y in zip(at[:-1], at[1:]):
            if y - x >= self.gram:
                out.append(np.unique(g[x : y - self.gram + 1]))
            elif y > x:
                out.append(self.units.span(p, np.array([x]), np.array([y])))
            else:
                out.append(np.zeros(0, dtype=U))
        return out


def identity(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set; 0, 0 for the empty one."""
    if not len(s):
        return 0, 0
    return int(mix(s).sum(dtype=U)), int(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _pack(sig: np.ndarray, ids: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Pairs dealt by signature. A blob holds the number of its sets, their 64-bit ids, how many signatures each has there, and 40 bits
    of each signature. (Two signatures of one set that agree in the 40 bits, of a chance of about 1 in 2 million
    for a set of 1,000 signatures, would count as one.)"""
    k = (sig >> U(11)) % U(buckets)
    order = np.lexsort((ids, k))
    k, sig, ids = k[order], sig[order], ids[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else []
    low = sig.view(np.uint8).reshape(-1, 8)[:, :5]
    for a, b in zip(at, [*at[1:], len(k)]):
        first, count = packedsteps.groups(ids[a:b])
        yield int(k[a]), np.array([len(first)], dtype=U).tobytes() + ids[a:b][first].tobytes() + count.astype(np.uint32).tobytes() + low[a:b].tobytes()


def _unpack(blobs: list[bytes], part: int, parts: int) -> np.ndarray:
    """(signature, set) of the signatures in a part of the domain."""
    out = []
    for blob in blobs:
        n = int(np.frombuffer(blob, dtype=U, count=1)[0])
        names = np.repeat(np.frombuffer(blob, dtype=U, count=n, offset=8), np.frombuffer(blob, dtype=np.uint32, count=n, offset=8 + 8 * n))
        rows = np.frombuffer(blob, dtype=np.uint8, offset=8 + 12 * n).reshape(-1, 5)
        mine = rows[:, 0] % parts == part
        sig = np.zeros((np.count_nonzero(mine), 8), dtype=np.uint8)
        sig[:, :5] = rows[mine]
        out.append(np.stack([sig.view(U).ravel(), names[mine]], axis=1))
    return np.concatenate(out)


_MEMBER = [("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("need", pa.int64())]
_SCANNED = pa.schema([*_MEMBER, ("bucket", pa.int64()), ("blob", pa.binary())])
_FOUND = pa.schema([*_MEMBER, ("bucket", pa.int64()), ("blob", pa.binary())])
_MEMBER_SQL = "doc_id long, row long, n long, h1 long, h2 long, need long"


def _filled(schema: pa.Schema, rows: int, /, **columns) -> pa.RecordBatch:
    """A batch with the other columns null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def _scan(gram: int, percent: int, buckets: int):
    """A row for each text, and rows of packed signatures and sets for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets_of, bands = Sets(gram), Bands(percent)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[tuple[int, int]] = set()
        n_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            got = list(_pack(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), buckets))
            held.clear()
            yield _filled(_SCANNED, len(got), bucket=[k for k, _ in got], blob=[v for _, v in got])

        for piece in slices(batches):
            sets = sets_of(piece.column("text"))
            ids = [identity(s) for s in sets]
            h = np.array(ids, dtype=U).reshape(-1, 2)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            h1 = _signed(h[:, 0].copy())
            new = []
            for i, x in enumerate(ids):
                if n[i] and x not in seen:  # copies that a task meets emit once
                    seen.add(x)
                    new.append(i)
            if len(seen) > 100_000:
                seen.clear()
            need: list[int | None] = [None] * len(sets)
            if new:
                who, sig, least = signatures(np.concatenate([sets[i] for i in new]), n[new], bands)
                for i, x in zip(new, least.tolist()):
                    need[i] = x
                held.append((sig, h[new, 0][who]))
                n_held += len(sig)
            yield _filled(_SCANNED, len(sets), doc_id=piece.column("doc_id"), row=piece.column("row"), n=n, h1=h1, h2=_signed(h[:, 1].copy()), need=need, bucket=(h1 >> 17) % buckets)
            if n_held > FLUSH:
                yield from flush()
                n_held = 0
        if held:
            yield from flush()

    return run


def _shared_of(blobs: list[bytes]) -> np.ndarray:
    """(signature, set) of the signatures in a bucket that two sets or more share, found part by part of their domain."""
    parts = min(64, 1 + (sum(map(len, blobs)) >> 21))
    return np.concatenate([_shared_in(_unpack(blobs, i, parts)) for i in range(parts)])


def _shared_in(rows: np.ndarray) -> np.ndarray:
    order = np.argsort(rows[:, 0])
    s = rows[order, 0]
    same = np.zeros(len(s) + 1, dtype=bool)
    same[1:-1] = s[1:] == s[:-1]
    rows = rows[order[same[1:] | same[:-1]]]
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 1].view(np.int64), rows[:, 0]))]
    rows = rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]]
    head = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
    n = np.diff(np.r_[head, len(rows)])
    return rows[np.repeat(n > 1, n)]


def _shared(buckets: int):
    """The texts' rows, and packed (set, signature) of signatures that two sets or more share. Batches come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                blob = batch.column("blob")
                rows = batch.filter(blob.is_null())
                if rows.num_rows:
                    done.append(_filled(_FOUND, rows.num_rows, **{c: rows.column(c) for c, _ in _MEMBER}))
                yield batch.filter(blob.is_valid())

        done: list[pa.RecordBatch] = []
        for _, blobs in by_bucket(pieces()):
            yield from done
            done.clear()
            rows = _shared_of(blobs)
            if len(rows):
                out = packedsteps.dealt(LISTS, rows[:, ::-1], rows[:, 1], buckets)
                yield _filled(_FOUND, out.num_rows, bucket=out.column("bucket"), blob=out.column("blob"))
        yield from done

    return run


#: Kinds of packed rows: (set, signature); (set, root, need, size, sketch); (signature, set, weight and mark); (set, hub); (signature, set, root, need, size, sketch);
#: (two sets, signatures that they must share, signatures shared); as ROOTED, with twice the block and whether another block is met. And rows that are not packed: two sets that are to meet; a whole set.
LISTS, ROOTS, WEIGHTS, HUBS, ROOTED, PAIRS, MEET, SETS, BLOCKED = range(1, 10)
#: Sets that one task holds against each other; a larger family is split into blocks, and each two blocks meet.
BLOCK = 1024
#: Sets of one signature whose pairs one task makes; and pairs that it holds at once.
LARGE, AT_ONCE = 8192, 1 << 17


def _weigh(buckets: int):
    """Weights are twice the number of signatures that the set shares, and one more in one group of each set."""

    def work(b) -> Iterator[pa.RecordBatch]:
        rows = b.rows(LISTS, 2)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        at, n = packedsteps.groups(rows[:, 0])
        weight = np.repeat(n, n).astype(U) << U(1)
        weight[at] |= U(1)
        yield packedsteps.dealt(WEIGHTS, np.stack([rows[:, 1], rows[:, 0], weight], axis=1), rows[:, 1], buckets)

    return work


def _hubs(buckets: int):
    """For each member of a group its hub: the set that shares the most signatures. A hub is its own in the group
    that its weight marks, so that sets that are hubs wherever they are come up too."""

    def work(b) -> Iterator[pa.RecordBatch]:
        rows = b.rows(WEIGHTS, 3)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 2] >> U(1), rows[:, 0]))]
        at, n = packedsteps.groups(rows[:, 0])
        hub = np.repeat(rows[at + n - 1, 1], n)
        rest = (rows[:, 1] != hub) | (rows[:, 2] & U(1) > 0)
        yield packedsteps.dealt(HUBS, np.stack([rows[rest, 1], hub[rest]], axis=1), rows[rest, 1], buckets)

    return work


def _best(b) -> Iterator[pa.RecordBatch]:
    """x: the hub that a set (y) shares the most groups with; the set itself if it has no other."""
    rows, n = np.unique(b.rows(HUBS, 2), axis=0, return_counts=True)
    order = np.lexsort((rows[:, 1], n, rows[:, 0] != rows[:, 1], rows[:, 0]))
    rows = rows[order]
    at, size = packedsteps.groups(rows[:, 0])
    best = rows[at + size - 1]
    yield packedsteps.batch(packedsteps.PLAIN, len(best), x=_signed(best[:, 1].copy()), y=_signed(best[:, 0].copy()))


def _attached(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its row's number in table (by first column, sorted), and whether there is one."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    i = np.minimum(np.searchsorted(table[:, 0], keys), len(table) - 1)
    return i, table[i, 0] == keys


def _root(buckets: int):
    def work(b) -> Iterator[pa.RecordBatch]:
        rows, roots = b.rows(LISTS, 2), b.rows(ROOTS, 4 + WORDS)
        roots = roots[np.argsort(roots[:, 0], kind="stable")]
        i, known = _attached(rows[:, 0], roots)
        rows, i = rows[known], i[known]
        if len(rows):
            yield packedsteps.dealt(ROOTED, np.concatenate([rows[:, ::-1], roots[i, 1:]], axis=1), rows[:, 1], buckets)

    return work


def _counted(rows: np.ndarray) -> np.ndarray:
    """Rows (a, b, need, shared) with those of equal pairs added up."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    at = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]) if len(rows) else np.zeros(0, dtype=np.int64)
    out = rows[at]
    if len(at):
        out[:, 3] = np.add.reduceat(rows[:, 3], at)
    return out


def cross_pairs(at: np.ndarray, n: np.ndarray, root: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers of one group and different roots, about `most` at a time. at, n: first row and size of each group, whose rows are sorted by root."""
    if not len(at):
        return
    rows = np.repeat(at, n) + ranges(n)
    end = np.repeat(at + n, n)
    edge = np.flatnonzero(np.r_[True, (root[rows[1:]] != root[rows[:-1]]) | (end[1:] != end[:-1])])
    size = np.diff(np.r_[edge, len(rows)])
    other = np.repeat(rows[edge] + size, size)  # the first row of the next root
    left = end - other
    total = np.cumsum(left)
    a = 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        yield np.repeat(rows[a:b], left[a:b]), np.repeat(other[a:b], left[a:b]) + ranges(left[a:b])
        a = b


def _meet_across(rows: np.ndarray, at: np.ndarray, n: np.ndarray, percent: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed pairs of one group and different roots, but for those whose sketches differ in more bits than linked sets do in elements."""
    held, n_held = [], 0
    for x, y in cross_pairs(at, n, rows[:, 2], AT_ONCE):
        differ = np.zeros(len(x), dtype=np.int64)
        for j in range(5, 5 + WORDS):
            differ += np.bitwise_count(rows[x, j] ^ rows[y, j])
        near = differ <= (100 - percent) * (rows[x, 4] + rows[y, 4]).astype(np.int64) // (100 + percent)
        if rows.shape[1] > 5 + WORDS:  # where two blocks meet, pairs of one block are left to where it is alone
            near &= (rows[x, -1] != rows[y, -1]) | (rows[x, -1] & U(1) == 0)
        x, y = x[near], y[near]
        if len(x):
            low, high = np.minimum(rows[x, 1], rows[y, 1]), np.maximum(rows[x, 1], rows[y, 1])
            held.append(_counted(np.stack([low, high, np.maximum(rows[x, 3], rows[y, 3]), np.ones(len(x), dtype=U)], axis=1)))
            n_held += len(held[-1])
        if n_held > FLUSH >> 1:
            held = [_counted(np.concatenate(held))]
            n_held = len(held[0])
        if n_held > FLUSH >> 1:
            yield packedsteps.dealt(PAIRS, held[0], mix(held[0][:, 0]) ^ held[0][:, 1], buckets)
            held, n_held = [], 0
    if n_held:
        out = _counted(np.concatenate(held))
        yield packedsteps.dealt(PAIRS, out, mix(out[:, 0]) ^ out[:, 1], buckets)


def _several(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ROOTED rows in order of signature and root; first row and size of the groups with several roots."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    at, n = packedsteps.groups(rows[:, 0])
    several = rows[at, 2] != rows[at + n - 1, 2] if len(rows) else np.zeros(0, dtype=bool)
    return rows, at[several], n[several]


def _across(percent: int, buckets: int):
    """Pairs of groups with several roots; in groups of one root, which are nearly all, no pair is made. A group of more
    than LARGE sets is dealt in blocks, before it has pairs: each two blocks meet under a key of their own."""

    def work(b) -> Iterator[pa.RecordBatch]:
        rows, at, n = _several(b.rows(ROOTED, 5 + WORDS))
        large = n > LARGE
        yield from _meet_across(rows, at[~large], n[~large], percent, buckets)
        for first, size in zip(at[large], n[large]):
            group, blocks = rows[first : first + size], -(-size // LARGE)
            block = mix(group[:, 1] + U(3)) % U(blocks)
            for i in range(blocks):
                mine = group[block == i]
                for j in range(blocks):
                    key = mine.copy()
                    key[:, 0] = mix(mine[:, 0] ^ mix(U(min(i, j) * 1_000_003 + max(i, j))))
                    side = np.full((len(key), 1), 2 * i + (i != j), dtype=U)
                    yield packedsteps.dealt(BLOCKED, np.concatenate([key, side], axis=1), key[:, 0], buckets)

    return work


def _blocks(percent: int, buckets: int):
    """Pairs as they are, and those of two blocks that meet."""

    def work(b) -> Iterator[pa.RecordBatch]:
        for _, _, _, blob in b.get(PAIRS, ()):
            pairs = np.frombuffer(blob, dtype=U).reshape(-1, 4)
            yield packedsteps.dealt(PAIRS, pairs, mix(pairs[:, 0]) ^ pairs[:, 1], buckets)
        rows, at, n = _several(b.rows(BLOCKED, 6 + WORDS))
        yield from _meet_across(rows, at, n, percent, buckets)

    return work


def _enough(b) -> Iterator[pa.RecordBatch]:
    """Pairs that share as many signatures as linked sets do at least."""
    rows = _counted(b.rows(PAIRS, 4))
    rows = rows[rows[:, 3] >= rows[:, 2]]
    yield packedsteps.batch(packedsteps.PLAIN, len(rows), x=_signed(rows[:, 0].copy()), y=_signed(rows[:, 1].copy()))


def _block(ids: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return (mix(ids + U(3)) % blocks.astype(U)).astype(np.int64)


def _meeting(family: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Where blocks i and j of a family meet."""
    low, high = np.minimum(i, j).astype(U), np.maximum(i, j).astype(U)
    return mix(family ^ mix(low * U(1_000_003) + high))


def _call(buckets: int):
    """Pairs at the meeting of their sets' blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y, family = (b.column(c).to_numpy().view(U) for c in ("a", "b", "family"))
                blocks = b.column("blocks").to_numpy()
                meeting = _meeting(family, _block(x, blocks), _block(y, blocks))
                yield packedsteps.batch(MEET, len(x), bucket=packedsteps.bucket_of(meeting, buckets), x=_signed(x), y=_signed(y), z=_signed(meeting))

    return run


def _settle(by: str, percent: int):
    """Of the pairs that meet in a bucket those that pass the test."""
    expand, test = TESTS[by]

    def work(b) -> Iterator[pa.RecordBatch]:
        sets = {(z, x): expand(blob) for x, _, z, blob in b.get(SETS, ())}
        found = [(x, y) for x, y, z, _ in b.get(MEET, ()) if test(sets[z, x], sets[z, y], percent)]
        yield packedsteps.batch(packedsteps.PLAIN, len(found), x=[x for x, _ in found], y=[y for _, y in found])

    return work


def _place_sets(by: str, buckets: int):
    """Sets (in the form that the test reads) at each meeting of their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, family = (b.column(c).to_numpy().view(U) for c in ("id", "family"))
            blocks = b.column("blocks").to_numpy()
            at = np.repeat(np.arange(b.num_rows), blocks)
            meeting = _meeting(family[at], _block(ids[at], blocks[at]), ranges(blocks))
            yield packedsteps.batch(
                SETS, len(at), bucket=packedsteps.bucket_of(meeting, buckets), x=_signed(ids[at]), z=_signed(meeting), blob=b.column(by).take(pa.array(at))
            )

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


_PAIR = ["a", "b", "ok"]


def _width(n: int) -> int:
    """Bytes of a hash that keep chance agreements of sets of n rare."""
    return 2 if n <= 1 << 10 else 3 if n <= 1 << 14 else 4


def compact(s: np.ndarray) -> bytes:
    """The low bytes of a set's hashes, sorted, and the set's size."""
    wide = _width(len(s))
    low = np.sort(s & U((1 << 8 * wide) - 1))
    return np.array([len(s), wide], dtype=np.int64).tobytes() + low.view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


#: 64-bit words of a parity sketch.
WORDS = 8
_SKETCH = [f"p{j}" for j in range(WORDS)]


def parity(s: np.ndarray) -> np.ndarray:
    """A bit for each cell of the domain: whether the set has an odd number of elements there. Two sets'
    sketches differ in no more bits than the sets differ in elements."""
    odd = np.bincount((mix(s) >> U(55)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U)


def _expand(blob: bytes) -> tuple[int, int, bool, np.ndarray]:
    """Size, width, whether some hashes have the same low bytes, and these, sorted."""
    n, wide = np.frombuffer(blob, dtype=np.int64, count=2).tolist()
    rows = np.zeros((n, 8), dtype=np.uint8)
    rows[:, :wide] = np.frombuffer(blob, dtype=np.uint8, offset=16).reshape(-1, wide)
    low = rows.view(U).ravel()
    return n, wide, bool((low[1:] == low[:-1]).any()), low


def may_link(x: tuple, y: tuple, percent: int) -> bool:
    """False only if the sets are not linked. Equal hashes have equal low bytes, so at
    least as many rows agree (counted with repeats) as the sets have in common."""
    (n, wx, dx, a), (m, wy, dy, b) = x, y
    if wx != wy:
        mask = U((1 << 8 * min(wx, wy)) - 1)
        a, b = np.sort(a & mask), np.sort(b & mask)
        dx = dy = True
    if dx or dy:
        va, ca = np.unique(a, return_counts=True)
        vb, cb = np.unique(b, return_counts=True)
        _, i, j = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
        common = int(np.minimum(ca[i], cb[j]).sum())
    else:
        both = np.concatenate([a, b])
        both.sort(kind="stable")
        common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (n + m - common)


#: Elements of a set to a cell of its tally, about.
EACH = 8


def tally(s: np.ndarray) -> bytes:
    """How many elements the set has in each cell of the domain, a byte each, after its size. Cells are a power of two in number;
    two next to each other make one of half as many. Nothing but the size if a byte can't hold a count."""
    cells = 1 << max(3, (len(s) // EACH).bit_length())
    count = np.bincount((mix(s ^ U(0x2545F4914F6CDD1D)) >> U(65 - cells.bit_length())).astype(np.int64), minlength=cells)
    return np.array([len(s)], dtype=np.int64).tobytes() + (count.astype(np.uint8).tobytes() if count.max() < 256 else b"")


def _tallied(blob: bytes) -> tuple[int, np.ndarray]:
    return int(np.frombuffer(blob, dtype=np.int64, count=1)[0]), np.frombuffer(blob, dtype=np.uint8, offset=8).astype(np.int16)


def near_tallies(x: tuple, y: tuple, percent: int) -> bool:
    """False only if the sets are not linked: sets differ in as many elements at least as their tallies do."""
    (n, a), (m, b) = x, y
    if not len(a) or not len(b):
        return True
    if len(a) != len(b):
        cells = min(len(a), len(b))
        a, b = a.reshape(cells, -1).sum(axis=1), b.reshape(cells, -1).sum(axis=1)
    return int(np.abs(a - b).sum()) <= (100 - percent) * (n + m) // (100 + percent)


#: What a test reads: the column of _Checker.small, how it is expanded, and the test of two of them.
TESTS: dict[str, tuple[Callable, Callable]] = {"tally": (_tallied, near_tallies), "elements": (_expand, may_link)}


def _stars(by: str, percent: int):
    """Pairs that pass the test: each member against its centre, which comes before the members of its key and salt."""
    expand, test = TESTS[by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, now = None, None
        for batch in batches:
            a, b = [], []
            for key, salt, role, i, blob in zip(*[batch.column(c).to_pylist() for c in ("key", "salt", "role", "id", by)]):
                if role == 0:
                    centre, now = expand(blob), (key, salt)
                elif now == (key, salt) and test(centre, expand(blob), percent):
                    a.append(key)
                    b.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_linked(np.frombuffer(x, dtype=U), np.frombuffer(y, dtype=U), percent) for x, y in zip(batch.column("ea").to_pylist(), batch.column("eb").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=_PAIR)

    return run


def _sets(gram: int, small: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets_of = Sets(gram)
        for piece in slices(batches):
            sets = sets_of(piece.column("text"))
            columns = [piece.column("id"), pa.array([compact(s) if small else s.tobytes() for s in sets], pa.binary())]
            if small:
                sketch = np.array([parity(s) for s in sets], dtype=U).reshape(-1, WORDS)
                columns += [pa.array([tally(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(_signed(sketch[:, j].copy())) for j in range(WORDS)]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "elements", *(["tally", "n", *_SKETCH] if small else [])])

    return run


class _Checker:
    """Checks of pairs of sets, against tables of the sets' texts and of their compact forms."""

    def __init__(self, texts: DataFrame, gram: int, percent: int):
        self.texts, self.gram, self.percent = texts, gram, percent
        sketch = ", ".join(f"{c} long" for c in _SKETCH)
        self.small = materialize(texts.mapInArrow(_sets(gram, True), f"id long, elements binary, tally binary, n long, {sketch}"), "compact")

    def sets(self, of: DataFrame) -> DataFrame:
        one = self.texts.join(of.select("id").distinct(), "id", "left_semi")
        return one.mapInArrow(_sets(self.gram, False), "id long, elements binary")

    def by_stars(self, pairs: DataFrame, by: str) -> DataFrame:
        """The pairs (a, b) that pass the test. What is known of each b meets that of a, in runs of at most STAR."""
        salts = pairs.groupBy(F.col("a").alias("key")).agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
        members = pairs.select(F.col("b").alias("id"), F.col("a").alias("key")).join(salts.hint("merge"), "key")
        members = members.select("id", "key", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"), F.lit(1).alias("role"))
        centres = salts.select(F.col("key").alias("id"), "key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
        placed = members.unionByName(centres).join(self.small.select("id", by).hint("merge"), "id")
        dealt = placed.repartition("key", "salt").sortWithinPartitions("key", "salt", "role")
        return materialize(dealt.mapInArrow(_stars(by, self.percent), "a long, b long"), by)

    def stars(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked: by tallies, then by compact sets; what they let through is settled by the whole sets."""
        for by in TESTS:
            pairs = self.by_stars(pairs, by)
            if pairs.isEmpty():
                return pairs
        return self.links(pairs)

    def families(self, pairs: DataFrame, buckets: int) -> DataFrame:
        """The pairs (a, b) that are linked, of which one set may have very many. After their tallies, sets that pairs connect are dealt in blocks of about
        BLOCK, and each two blocks meet as compact sets; what these let through is settled by the whole sets."""
        if pairs.isEmpty() or (pairs := self.by_stars(pairs, "tally")).isEmpty():
            return pairs
        members = components(pairs).select("id", F.col("root").alias("family"))
        sizes = members.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
        members = materialize(members.join(sizes, "family"), "families")
        calls = pairs.join(members.withColumnRenamed("id", "a"), "a").mapInArrow(_call(buckets), packedsteps.SQL)
        placed = self.small.select("id", "elements").join(members, "id").mapInArrow(_place_sets("elements", buckets), packedsteps.SQL)
        met = packedsteps.step(calls.unionByName(placed), _settle("elements", self.percent), spread=True)
        return self.links(materialize(met.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "likely"))

    def links(self, likely: DataFrame) -> DataFrame:
        """Of the pairs (a, b) those that are linked, by the whole sets."""
        full = materialize(self.sets(likely.select(F.explode(F.array("a", "b")).alias("id"))), "sets")
        with_a = likely.join(full.select(F.col("id").alias("a"), F.col("elements").alias("ea")), "a")
        with_b = with_a.join(full.select(F.col("id").alias("b"), F.col("elements").alias("eb")), "b")
        return materialize(with_b.select("a", "b", "ea", "eb").mapInArrow(_pairs(self.percent), "a long, b long, ok boolean").filter("ok").select("a", "b"), "linked")


def jaccard_classes(docs: DataFrame, text: Column, doc_id: Column, percent: int = 80, gram: int = 5) -> DataFrame:
    """doc_id, row (a hash of id and text), n_shingles, component (null without words) and component_id of every row.

    Sets of hashed n-grams of words (ASCII letters lowered) link where 100 *
    intersection >= percent * union; component_id is the least doc_id reachable
    by links. Texts without words (null, empty) link with nothing and are their own
    component. Repeated rows are rows like others: equal sets link. A null doc_id takes part; its component_id is
    the least id of the others, or null. An empty table gives no rows.

    Sets are compared by 64-bit hashes of n-grams and known by 64-bit hashes
    while candidates are sought, by 128 bits when rows are put in classes.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(doc_id.cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("row", row_key(F.col("doc_id"), F.col("text")))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, total >> 24)
    scan = rows.mapInArrow(_scan(gram, percent, buckets), f"{_MEMBER_SQL}, bucket long, blob binary")
    found = materialize(scan.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared(buckets), f"{_MEMBER_SQL}, bucket long, blob binary"), "found")
    members = found.filter("blob IS NULL").select("doc_id", "row", "n", "h1", "h2")
    null = F.lit(None).cast("long")
    lists = found.filter("blob IS NOT NULL").select(F.lit(LISTS).alias("kind"), "bucket", null.alias("x"), null.alias("y"), null.alias("z"), "blob")
    # Each set with the likeliest other: this links most of what is to be linked.
    weighed = packedsteps.step(packedsteps.step(lists, _weigh(buckets)), _hubs(buckets))
    tried = materialize(packedsteps.step(weighed, _best).select(F.col("x").alias("a"), F.col("y").alias("b")), "pairs")
    # The text of one row for each set that shares a signature, and the fewest signatures that it shares with a linked one.
    one = found.filter("n > 0").groupBy(F.col("h1").alias("id")).agg(F.min("row").alias("row"), F.max("need").alias("need"))
    wanted = materialize(tried.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(one, "id"), "wanted")
    texts = materialize(rows.select("row", "text").join(wanted.select("id", "row").hint("merge"), "row").select("id", "text"), "texts")
    checker = _Checker(texts, gram, percent)
    links = checker.stars(tried.filter("a <> b"))
    roots = components(links)
    # Pairs that still share signatures across components meet family by family.
    known = wanted.join(roots, "id", "left").join(checker.small.select("id", "n", *_SKETCH), "id").withColumn("root", F.coalesce("root", "id"))
    rooted = packedsteps.step(lists.unionByName(packedsteps.pack(known, ROOTS, ["id", "root", "need", "n", *_SKETCH], buckets)), _root(buckets))
    met = packedsteps.step(packedsteps.step(rooted, _across(percent, buckets)), _blocks(percent, buckets))
    pairs = materialize(packedsteps.step(met, _enough).select(F.col("x").alias("a"), F.col("y").alias("b")), "across")
    more = checker.families(pairs, buckets)
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    release(tried, wanted, texts, checker.small, pairs)
    return _classes(members, roots)


def _classes(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Each row's least reachable doc_id, by sums over classes before rows are met again."""
    classes = members.filter("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(roots.withColumnRenamed("id", "h1"), "h1", "left").select("h1", "h2", "least", F.coalesce("root", "h1").alias("component"))
    of_root = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    known = rooted.join(of_root, "component").select("h1", "h2", "component", "component_id")
    met = members.filter("n > 0").join(known, ["h1", "h2"])
    names = ["doc_id", "row", F.col("n").alias("n_shingles"), "component", "component_id"]
    return met.select(*names).unionByName(
        members.filter("n = 0").select("doc_id", "row", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    )


def join_documents(docs: DataFrame) -> DataFrame:
    """One row for every row of documents, repeated ones too; null and empty texts have no shingles and are their own component."""
    return jaccard_classes(docs, F.col("text"), F.col("doc_id"), percent=85, gram=4).select("doc_id", "n_shingles", "component_id")


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 80, gram: int = 5) -> DataFrame:
    """docs with one row of each group of linked rows: the one of least doc_id
    (null first), then of least hash. Rows without words all stay."""
    classes = jaccard_classes(docs, F.col(text), F.col(doc_id), percent, gram)
    best = classes.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("best")).select(F.col("best.row").alias("__row"))
    keep = materialize(best.unionByName(classes.filter("component IS NULL").select(F.col("row").alias("__row")).distinct()), "kept")
    rows = docs.withColumn("__row", row_key(F.col(doc_id), F.col(text))).join(keep, "__row", "left_semi")
    # Repeated rows meet in each task first, so one that is repeated very often is no large group; those without words are told apart.
    each = F.when(word_count(F.col(text)) == 0, F.monotonically_increasing_id())
    return rows.withColumn("__each", each).dropDuplicates(["__row", "__each"]).drop("__row", "__each")


ORACLE = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT rid, array_to_string(ws[i + 1:i + 4], ' ') AS x FROM (SELECT rid, ws, unnest(range(0, greatest(1, len(ws) - 3))) AS i FROM d WHERE len(ws) > 0)),
e AS (SELECT DISTINCT rid, x FROM s),
n AS (SELECT rid, count(*) AS n FROM e GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.rid < b.rid GROUP BY a.rid, b.rid),
l AS (SELECT a, b FROM p JOIN n x ON x.rid = p.a JOIN n y ON y.rid = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
w AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT rid, rid FROM d UNION SELECT r.a, w.b FROM r JOIN w ON r.b = w.a),
c AS (SELECT r.a, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.b GROUP BY r.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n ON n.rid = d.rid JOIN c ON c.a = d.rid
"""
