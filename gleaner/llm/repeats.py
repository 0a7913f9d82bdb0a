"""Windows of a fixed number of units (words, bytes) that occur more than once: how suffixes are dealt into groups that fit in memory.

What the two operators on repeated passages share. How a group's suffixes are put in order is theirs.

A window, and so the suffix that starts with it, is known by an anchor inside it: the place, among its first `gap`, where a
rolling hash is least. Equal windows have equal anchors at equal offsets, and one anchor stands for a run of
suffixes (its stretch), so anchors are few. Each step is a scan or a shuffle of packed rows:

1. Anchors are dealt by the prefix that all their windows hold: the units from the anchor on. So a suffix is dealt by
   a prefix of varying length, from its start to the end of what follows its anchor. A prefix that occurs
   once is done with. Equal stretches are one node of the tree, each leaf of which is repeated; one of them goes on for all.
2. The stretches of a prefix meet in a task, which puts their suffixes in order and finds the deep nodes.
   A prefix with more than `most` stretches is lengthened to the whole window: below it is one deep node or one leaf, so the suffixes are only counted.
3. Each text is met again with its repeated windows.

Equal texts count once in 1 and 2 (within a task; then when rows meet), and are repeated as a whole. A task puts together what it has of a
prefix, stretch or window before it is dealt, so that a passage that very many documents hold costs few rows from each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, small_batches
from .units import U, give_back, ranges, slices

FLUSH = 1 << 19
#: Stretches of one prefix that one task puts in order; and units put in order at once.
MOST, AT_ONCE = 4096, 1 << 20
RESOLVED, OPEN, WITNESS, LONG = 1, 2, 4, 8
NOWHERE = U((1 << 64) - 1)


class Shape(NamedTuple):
    length: int  # units of a window
    gap: int  # places among which an anchor is sought
    gram: int  # units that the rolling hash covers
    wide: int  # bytes of a unit in a stretch
    most: int = MOST


class Parsed(NamedTuple):
    """Units of some texts. at: each text's range among the units (n + 1)."""

    at: np.ndarray
    units: np.ndarray
    prefix: np.ndarray  # rolling sums over units
    span: Callable  # hashes of spans of units
    kept: Callable  # (text, keep mask over its units) -> the kept text's bytes


class Anchors(NamedTuple):
    text: np.ndarray  # number of the text
    place: np.ndarray  # unit, counted in the whole piece
    low: np.ndarray  # first and last window start that it stands for
    high: np.ndarray


def anchors(p: Parsed, s: Shape) -> Anchors:
    n = int(p.at[-1])
    size = np.diff(p.at)
    windows = np.maximum(size - s.length + 1, 0)
    starts = np.repeat(p.at[:-1], windows) + ranges(windows)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return Anchors(none, none, none, none)
    m = max(n - s.gram + 1, 1)
    bits = U(max(1, int(m).bit_length()))
    a = np.arange(m)
    key = (p.span(p.prefix, a, a + s.gram) >> bits << bits) | a.astype(U)
    reach = 1
    while reach < s.gap:
        step = min(reach, s.gap - reach)
        key = np.minimum(key[: len(key) - step], key[step:])
        reach += step
    least = (key[starts] & ((U(1) << bits) - U(1))).astype(np.int64)
    text = np.repeat(np.arange(len(size)), windows)
    new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])])
    end = np.r_[new[1:], len(starts)] - 1
    return Anchors(text[new], least[new], starts[new], starts[end])


def _prefix(p: Parsed, place: np.ndarray, s: Shape) -> np.ndarray:
    return p.span(p.prefix, place, place + (s.length - s.gap + 1))


#: Kinds of rows: a text; anchors (prefix, stretch, text, twice the place and whether it stands for several); verdicts (text, place and verdict);
#: stretches; windows (hash, text, twice the place and whether it stands for several); starts of repeated windows (text, place).
TEXT, ANCHORS, VERDICTS, STRETCHES, WINDOWS, STARTS = range(6)
_DEALT = pa.schema([("row", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("blob", pa.binary())])
DEALT_SQL = "row long, kind int, bucket long, blob binary"


def _deal(kind: int, key: np.ndarray, rows: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    """(kind, bucket, blob) of rows of numbers."""
    k = (key >> U(11)) % U(buckets)
    order = np.argsort(k, kind="stable")
    k, rows = k[order], np.ascontiguousarray(rows[order])
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else []
    return [(kind, int(k[a]), rows[a:b].tobytes()) for a, b in zip(at, [*at[1:], len(k)])]


def _rows(blobs: list[bytes], columns: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=U).reshape(-1, columns)


def _sorted(rows: np.ndarray, marked: bool) -> np.ndarray:
    """Distinct rows in order. marked: the last column ends in a bit, and of rows that differ in it only one with it stays."""
    rows = rows[np.lexsort(rows.T[::-1])]
    if len(rows):
        same = (rows[1:, :-1] == rows[:-1, :-1]).all(axis=1) & (rows[1:, -1] >> U(marked) == rows[:-1, -1] >> U(marked))
        rows = rows[np.r_[~same, True]]
    return rows


def _heads(rows: np.ndarray, columns: int) -> np.ndarray:
    """Where rows begin that differ from the one before in the first columns."""
    return np.r_[True, (rows[1:, :columns] != rows[:-1, :columns]).any(axis=1)] if len(rows) else np.zeros(0, dtype=bool)


def _sums(head: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each row, the sum of x over the rows from its head to the next."""
    at = np.flatnonzero(head)
    return np.repeat(np.add.reduceat(x, at), np.diff(np.r_[at, len(x)])) if len(at) else x


def gather(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors (prefix, stretch, text, place) that a task has: what of them is dealt, and what verdicts are known at once.

    Of equal stretches one goes on, marked; the others are repeated. Of a prefix with more than `most` stretches only the fact goes on."""
    rows = _sorted(rows, False)
    if not len(rows):
        return rows, np.zeros((0, 2), dtype=U)
    head = _heads(rows, 2)
    several = _sums(head, np.ones(len(rows), dtype=np.int64)) > 1
    again = rows[~head]
    known = [np.stack([again[:, 2], again[:, 3] << U(4) | U(RESOLVED)], axis=1)]
    rows, several = rows[head], several[head]
    node = _heads(rows, 1)
    long = _sums(node, np.ones(len(rows), dtype=np.int64)) > most
    verdict = np.where(several, RESOLVED | WITNESS | LONG, OPEN | LONG).astype(U)
    known.append(np.stack([rows[:, 2], rows[:, 3] << U(4) | verdict], axis=1)[long])
    marks = rows[node & long].copy()
    marks[:, 1:] = NOWHERE
    sent = rows[~long].copy()
    sent[:, 3] = sent[:, 3] << U(1) | several[~long]
    return np.concatenate([sent, marks]), np.concatenate(known)


def judge(rows: np.ndarray, most: int) -> np.ndarray:
    """(text, place and verdict) of anchors whose prefix occurs twice or more."""
    rows = _sorted(rows, True)
    if not len(rows):
        return np.zeros((0, 2), dtype=U)
    node, edge = _heads(rows, 1), _heads(rows, 2)
    mark = rows[:, 2] == NOWHERE
    again = _sums(edge, 1 + (rows[:, 3] & U(1)).astype(np.int64)) > 1
    long = (_sums(node, edge.astype(np.int64)) > most) | (_sums(node, mark.astype(np.int64)) > 0)
    any_open = (_sums(node, (~again).astype(np.int64)) > 0) | long
    verdict = np.where(again, RESOLVED, OPEN) | np.where(again & edge & any_open, WITNESS, 0) | np.where(long, LONG, 0)
    keep = ((_sums(node, np.ones(len(rows), dtype=np.int64)) > 1) | again) & ~mark
    return np.stack([rows[keep, 2], rows[keep, 3] >> U(1) << U(4) | verdict[keep].astype(U)], axis=1)


def _scan(parse: Callable, s: Shape, buckets: int):
    """Packed anchors and known verdicts for each bucket; and a row for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, held, n_held, seen = parse(), [], 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            sent, known = gather(np.concatenate(held), s.most)
            held.clear()
            got = _deal(ANCHORS, sent[:, 0], sent, buckets) + _deal(VERDICTS, known[:, 0], known, buckets)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(got), pa.int64()), *[pa.array([x[i] for x in got], _DEALT.field(i + 1).type) for i in range(3)]], schema=_DEALT)

        for piece in slices(batches):
            row = piece.column("row").to_numpy()
            fresh = np.array([not (r in seen or seen.add(r)) for r in row.tolist()], dtype=bool)
            if len(seen) > 200_000:
                seen.clear()
            n = len(row)
            yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(np.full(n, TEXT, dtype=np.int32)), pa.array((row >> 17) % buckets), pa.nulls(n, pa.binary())], schema=_DEALT)
            p = work(piece.column("text"))
            found = anchors(p, s)
            keep = fresh[found.text]
            text, place, low, high = (x[keep] for x in found)
            if not len(text):
                continue
            whole = p.span(p.prefix, low, high + s.length)
            held.append(np.stack([_prefix(p, place, s), whole, row[text].view(U), (place - p.at[text]).astype(U)], axis=1))
            n_held += len(text)
            if n_held > FLUSH:
                yield from flush()
                n_held = 0
        if held:
            yield from flush()

    return run


_KNOWN = pa.schema([("row", pa.int64()), ("place", pa.int64())])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _by_bucket(batches: Iterator[pa.RecordBatch], pass_on: Callable) -> Iterator[dict[int, list[bytes]]]:
    """The blobs of each bucket by kind; pass_on gets the rows without a blob."""
    now, got = None, {}
    for batch in batches:
        blob = batch.column("blob")
        rest = batch.filter(blob.is_null())
        if rest.num_rows:
            pass_on(rest)
        batch = batch.filter(blob.is_valid())
        for kind, k, x in zip(*[batch.column(c).to_pylist() for c in ("kind", "bucket", "blob")]):
            if k != now and got:
                yield got
                got = {}
            now = k
            got.setdefault(kind, []).append(x)
    if got:
        yield got
    got = {}
    give_back()


def _judged(most: int):
    """The texts' rows (place null), and (text, place and verdict) of repeated prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[pa.RecordBatch] = []
        pass_on = lambda rows: done.append(pa.RecordBatch.from_arrays([rows.column("row"), pa.nulls(rows.num_rows, pa.int64())], schema=_KNOWN))
        for got in _by_bucket(batches, pass_on):
            yield from done
            done.clear()
            for rows in (judge(_rows(got.get(ANCHORS, []), 4), most), _rows(got.get(VERDICTS, []), 2)):
                if len(rows):
                    yield pa.RecordBatch.from_arrays([_signed(rows[:, 0]), _signed(rows[:, 1])], schema=_KNOWN)
        yield from done

    return run


def count(rows: np.ndarray) -> np.ndarray:
    """(text, place) of windows (hash, text, marked place) whose hash occurs twice or more."""
    rows = _sorted(rows, True)
    again = _sums(_heads(rows, 1), 1 + (rows[:, 2] & U(1)).astype(np.int64)) > 1
    return np.stack([rows[again, 1], rows[again, 2] >> U(1)], axis=1)


def gather_windows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (hash, text, place) that a task has: one of each hash, marked if there are several; and the (text, place) of the others, which are repeated."""
    rows = _sorted(rows, False)
    head = _heads(rows, 1)
    several = _sums(head, np.ones(len(rows), dtype=np.int64)) > 1
    sent = rows[head].copy()
    sent[:, 2] = sent[:, 2] << U(1) | several[head]
    return sent, rows[~head][:, 1:]


def _pack_stretches(keys: np.ndarray, units: np.ndarray, s: Shape, buckets: int) -> list[tuple[int, int, bytes]]:
    """keys: (prefix, text, first start, twice the number of windows and whether it only bears witness) of each stretch; units: theirs, one after the other.
    A blob holds the number of its stretches, their keys and their units."""
    k = (keys[:, 0] >> U(11)) % U(buckets)
    order = np.argsort(k, kind="stable")
    size = (keys[:, 3] >> U(1)).astype(np.int64) + s.length - 1
    first = np.cumsum(size) - size
    k, keys, size = k[order], keys[order], size[order]
    raw = np.ascontiguousarray(units[np.repeat(first[order], size) + ranges(size)])
    raw = raw.view(np.uint8).reshape(len(raw), -1)[:, : s.wide]
    ends = np.cumsum(size)
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return [
        (STRETCHES, int(k[a]), np.array([b - a], dtype=U).tobytes() + keys[a:b].tobytes() + raw[ends[a] - size[a] : ends[b - 1]].tobytes())
        for a, b in zip(at, [*at[1:], len(k)])
    ]


def _unpack_stretches(blobs: list[bytes], s: Shape) -> tuple[np.ndarray, np.ndarray]:
    keys, units = [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, dtype=U, count=1)[0])
        keys.append(np.frombuffer(blob, dtype=U, count=4 * n, offset=8).reshape(-1, 4))
        units.append(np.frombuffer(blob, dtype=np.uint8, offset=8 + 32 * n).reshape(-1, s.wide))
    raw = np.concatenate(units)
    if s.wide == 1:
        return np.concatenate(keys), raw.ravel()
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, : s.wide] = raw
    return np.concatenate(keys), out.view(U).ravel()


def put_in_order(blobs: list[bytes], s: Shape, order: Callable, at_once: int = AT_ONCE) -> Iterator[np.ndarray]:
    """(text, place) of windows that `order` finds repeated, group by group of prefixes; about at_once units are in order at a time."""
    keys, units = _unpack_stretches(blobs, s)
    size = (keys[:, 3] >> U(1)).astype(np.int64) + s.length - 1
    first = np.cumsum(size) - size
    by = np.lexsort((keys[:, 3], keys[:, 2], keys[:, 1], keys[:, 0]))
    by = by[_heads(keys[by], 3)]  # equal texts of several tasks come once
    keys, size, first = keys[by], size[by], first[by]
    ends = np.r_[np.flatnonzero(_heads(keys, 1))[1:], len(keys)]
    total = np.cumsum(size)
    a = 0
    while a < len(keys):
        later = ends[ends > a]
        fit = later[total[later - 1] - total[a] + size[a] <= at_once]
        b = int(fit[-1] if len(fit) else later[0])
        mine = units[np.repeat(first[a:b], size[a:b]) + ranges(size[a:b])]
        windows = (keys[a:b, 3] >> U(1)).astype(np.int64)
        found = order(mine, np.cumsum(size[a:b]) - size[a:b], windows, s.length)
        found &= np.repeat(keys[a:b, 3] & U(1) == 0, windows)
        which = np.repeat(np.arange(a, b), windows)[found]
        yield np.stack([keys[which, 1], keys[which, 2] + ranges(windows)[found].astype(U)], axis=1)
        a = b


def _found(s: Shape, order: Callable):
    """(text, place) of repeated windows, from stretches and windows of a bucket and from what is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in _by_bucket(batches, lambda _: None):
            pieces = [_rows(got.get(STARTS, []), 2)]
            if WINDOWS in got:
                pieces.append(count(_rows(got[WINDOWS], 3)))
            if STRETCHES in got:
                pieces += put_in_order(got[STRETCHES], s, order)
            for rows in pieces:
                if len(rows):
                    yield pa.RecordBatch.from_arrays([_signed(rows[:, 0]), _signed(rows[:, 1])], schema=_KNOWN)

    return run


def _numbers(column: pa.Array, i: int) -> np.ndarray:
    x = column[i]
    return np.sort(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else np.zeros(0, dtype=np.int64)


_STRETCH = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_RESULT = [("n_units", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(_STRETCH)), ("kept_sha256", pa.string()), ("kept", pa.binary())]
RESULT_SQL = "n_units long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary"


def _outcome(p: Parsed, i: int, starts: np.ndarray, whole: bool, s: Shape, keep_text: bool) -> tuple:
    """Of text i, given the starts (in the text) of its repeated windows."""
    n = int(p.at[i + 1] - p.at[i])
    delta = np.zeros(n + 1, dtype=np.int64)
    if whole and n >= s.length:
        delta[0], delta[n] = 1, -1
    elif len(starts):
        np.add.at(delta, starts, 1)
        np.add.at(delta, starts + s.length, -1)
    gone = np.cumsum(delta[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
    spans = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]
    kept = p.kept(i, ~gone)
    return n, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None


def _verdicts(mark: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The verdicts (together) on each place. mark: sorted places and verdicts."""
    if not len(mark) or not len(place):
        return np.zeros(len(place), dtype=np.int64)
    at = np.flatnonzero(np.r_[True, mark[1:] >> 4 != mark[:-1] >> 4])
    where, verdict = mark[at] >> 4, np.bitwise_or.reduceat(mark & 15, at)
    k = np.minimum(np.searchsorted(where, place), len(where) - 1)
    return np.where(where[k] == place, verdict[k], 0)


def _meet(parse: Callable, s: Shape, buckets: int, carry: list[str], keep_text: bool):
    """Each text with the verdicts on its anchors: its result; or, where suffixes must
    still be put in order, the text and the repeated windows so far. And packed stretches and windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, seen = parse(), set()
        keys: list[np.ndarray] = []
        units: list[np.ndarray] = []
        windows: list[np.ndarray] = []
        size = 0
        schema = None

        def flush() -> Iterator[pa.RecordBatch]:
            got = _pack_stretches(np.concatenate(keys), np.concatenate(units), s, buckets) if keys else []
            if windows:
                sent, known = gather_windows(np.concatenate(windows))
                got += _deal(WINDOWS, sent[:, 0], sent, buckets) + _deal(STARTS, known[:, 0], known, buckets)
            for x in (keys, units, windows):
                x.clear()
            filled = {c: pa.array([x[i] for x in got], _DEALT.field(c).type) for i, c in enumerate(("kind", "bucket", "blob"))}
            yield pa.RecordBatch.from_arrays([filled.get(f.name, pa.nulls(len(got), f.type)) for f in schema], schema=schema)

        for piece in slices(batches):
            if schema is None:
                schema = pa.schema([*[piece.schema.field(c) for c in carry], *_RESULT, ("row", pa.int64()), ("text", pa.string()), ("starts", pa.list_(pa.int64())), *list(_DEALT)[1:]])
            p = work(piece.column("text"))
            found = anchors(p, s)
            at = np.searchsorted(found.text, np.arange(piece.num_rows + 1))
            rows, copies, marks = piece.column("row").to_pylist(), piece.column("copies").to_pylist(), piece.column("marks")
            if len(seen) > 200_000:
                seen.clear()
            out: list[list] = [[] for _ in range(len(_RESULT) + 3)]
            for i, row in enumerate(rows):
                mine = slice(at[i], at[i + 1])
                base = p.at[i]
                place, low, high = found.place[mine], found.low[mine], found.high[mine]
                verdict = _verdicts(_numbers(marks, i), place - base)
                sure = (verdict & RESOLVED) > 0
                c = high[sure] - low[sure] + 1
                starts = np.repeat(low[sure], c) + ranges(c) - base
                whole = copies[i] > 1
                asked = (verdict & (OPEN | WITNESS)) > 0
                if asked.any() and row not in seen:
                    seen.add(row)
                    me = np.array([row], dtype=np.int64).view(U)[0]
                    some = asked & (verdict & LONG == 0)
                    if some.any():
                        c = high[some] - low[some] + 1
                        keys.append(np.stack([_prefix(p, place[some], s), np.full(len(c), me), (low[some] - base).astype(U), (c << 1 | sure[some]).astype(U)], axis=1))
                        units.append(p.units[np.repeat(low[some], c + s.length - 1) + ranges(c + s.length - 1)])
                        size += len(units[-1])
                    some = asked & (verdict & LONG > 0)
                    if some.any():
                        c = high[some] - low[some] + 1
                        w = np.repeat(low[some], c) + ranges(c)
                        windows.append(np.stack([p.span(p.prefix, w, w + s.length), np.full(len(w), me), (w - base).astype(U)], axis=1))
                        size += 4 * len(w)
                wait = not whole and bool(((verdict & OPEN > 0) & ~sure).any())
                result = (None,) * len(_RESULT) if wait else _outcome(p, i, starts, whole, s, keep_text)
                more = (row, None, starts) if wait else (row, None, None)
                for column, x in zip(out, (*result, *more)):
                    column.append(x)
            texts = piece.column("text").to_pylist()
            filled = {f.name: pa.array(x, f.type) for f, x in zip(list(schema)[len(carry) :], out)}
            filled["text"] = pa.array([t if st is not None else None for t, st in zip(texts, out[-1])], pa.string())
            for c in carry:
                filled[c] = piece.column(c)
            yield pa.RecordBatch.from_arrays([filled.get(f.name, pa.nulls(piece.num_rows, f.type)) for f in schema], schema=schema)
            if size > 4 * FLUSH:
                yield from flush()
                size = 0
        if keys or windows:
            yield from flush()

    return run


def _finish(parse: Callable, s: Shape, carry: list[str], keep_text: bool):
    """Results of the texts that waited for the order of their suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = parse()
        for piece in slices(batches):
            p = work(piece.column("text"))
            before, more = piece.column("starts"), piece.column("more")
            results = [_outcome(p, i, np.concatenate([_numbers(before, i), _numbers(more, i)]), False, s, keep_text) for i in range(piece.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*[piece.column(c) for c in carry], *[pa.array([r[k] for r in results], kind) for k, (_, kind) in enumerate(_RESULT)]],
                names=[*carry, *[n for n, _ in _RESULT]],
            )

    return run


def _to_buckets(df: DataFrame, spread: bool = False) -> DataFrame:
    """spread: the time of a bucket doesn't follow its bytes, so partitions are not put together by size."""
    rows = df.select("row", "kind", "bucket", "blob")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(n, "bucket") if spread else rows.repartition("bucket")).sortWithinPartitions("bucket")


def remove_repeats(docs: DataFrame, parse: Callable, s: Shape, order: Callable, carry: list[str], text: str, keep_text: bool) -> DataFrame:
    """The carried columns with those of RESULT_SQL, which replace carried ones of their names, for every row of docs.

    order(units, first, windows, length): for each window of some stretches whether it is repeated among them."""
    small_batches(docs.sparkSession)
    at = {c: f"__c{i}" for i, c in enumerate(carry)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, total >> 22)
    scan = rows.select("row", "text").mapInArrow(_scan(parse, s, buckets), DEALT_SQL)
    known = materialize(_to_buckets(scan).mapInArrow(_judged(s.most), "row long, place long"), "anchors")
    facts = known.groupBy("row").agg(F.count(F.when(F.col("place").isNull(), 1)).alias("copies"), F.collect_list("place").alias("marks"))
    typed = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for c, n in at.items())
    met = rows.join(facts, "row").mapInArrow(_meet(parse, s, buckets, list(at.values()), keep_text), f"{typed}{RESULT_SQL}, row long, text string, starts array<long>, kind int, bucket long, blob binary")
    met = materialize(met, "met")
    found = _to_buckets(met.filter("blob IS NOT NULL"), spread=True).mapInArrow(_found(s, order), "row long, place long")
    more = found.groupBy("row").agg(F.collect_list("place").alias("more"))
    waiting = met.filter("starts IS NOT NULL").select(*at.values(), "row", "text", "starts").join(more, "row", "left")
    finished = waiting.mapInArrow(_finish(parse, s, list(at.values()), keep_text), f"{typed}{RESULT_SQL}")
    new = [n for n, _ in _RESULT]
    names = [*at.values(), *new]
    out = met.filter("blob IS NULL AND starts IS NULL").select(*names).unionByName(finished.select(*names))
    return out.select(*[F.col(n).alias(c) for c, n in at.items() if c not in new], *new)
