"""Benchmark decontamination by an FM-index per shard of the corpus.

A task gathers documents into shards of bounded size and indexes each shard's
words. Words outside the benchmark's vocabulary match nothing: they part the
shard into segments, and segments shorter than the shortest phrase are left out.
All phrases are searched backward at once, their occurrences are located, and
the covered words are merged into removal spans. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .store import materialize, release, small_batches
from .units import ALNUM, LOWER, Hasher, U, flat, mix, ranges, slices, words

WINDOW = 10
SHARD_BYTES = 8 << 20
#: Bytes of benchmark text that the driver holds and that are searched for in one pass; a larger benchmark takes several passes.
BLOCK_BYTES = 32 << 20


#: Phrases that a task searches for at once.
CHUNK = 1 << 16


class Phrases:
    """The distinct windows of some benchmark items, kept as the items' words: four bytes a word, a bit that tells where a distinct window starts first, and a
    pair of numbers for each further item that has it."""

    def __init__(self, ids: Sequence[str | None], texts: Sequence[str | None], window: int):
        h, hashes, sizes = Hasher(21), [np.zeros(0, dtype=U)], [np.zeros(0, dtype=np.int64)]
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
        for piece in slices(iter([batch])):
            raw, off = flat(piece.column("text"))
            a, b, at = words(raw, off, ALNUM)
            hashes.append(h.span(h.prefix(h.of_byte[LOWER[raw]]), a, b))
            sizes.append(np.diff(at))
        self.window, size = window, np.concatenate(sizes)
        self.vocabulary, symbol = np.unique(np.concatenate(hashes), return_inverse=True)
        self.symbols = (symbol + 1).astype(np.int32)
        del hashes, symbol
        names: dict[str | None, int] = {}
        self.codes = np.array([names.setdefault(x, len(names)) for x in ids], dtype=np.int32)
        self.names, self.begins = list(names), np.concatenate([[0], np.cumsum(size)])
        self.least = int(np.minimum(size, window)[size > 0].min()) if (size > 0).any() else 0
        starts = np.repeat(self.begins[:-1], self._windows(size)) + ranges(self._windows(size))
        first, again, of = self._distinct(starts)
        mask = np.zeros(len(self.symbols), dtype=bool)
        mask[first] = True
        self.mask = np.packbits(mask)
        # Windows that start elsewhere too: the number of the first in order of places, and the item.
        pair = np.unique(np.searchsorted(np.sort(first), of) * np.int64(max(1, len(names))) + self.codes[self._item(again)])
        self.more = (pair // max(1, len(names))).astype(np.int32), (pair % max(1, len(names))).astype(np.int32)

    def _windows(self, size: np.ndarray) -> np.ndarray:
        return np.where(size > 0, size - np.minimum(size, self.window) + 1, 0)

    def _item(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, starts, side="right") - 1

    def rows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of windows, right-aligned behind zeros, and their lengths."""
        item = self._item(starts)
        length = np.minimum(self.begins[item + 1] - self.begins[item], self.window)
        at = starts[:, None] + np.arange(self.window)[None, :] - (self.window - length)[:, None]
        return np.where(at >= starts[:, None], self.symbols[np.maximum(at, 0)], 0).astype(np.int64), length

    def _distinct(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First start of each distinct window; all other starts; and the first start of each of these."""
        h, hashes = Hasher(22), [np.zeros(0, dtype=U)]
        for i in range(0, len(starts), CHUNK):
            rows, _ = self.rows(starts[i : i + CHUNK])
            prefix = h.prefix(mix(rows.ravel().astype(U)))
            low = np.arange(len(rows)) * self.window
            hashes.append(h.span(prefix, low, low + self.window))
        hashes = np.concatenate(hashes)
        order = np.argsort(hashes, kind="stable")
        new = np.ones(len(order), dtype=bool)
        for i in range(1, len(order), CHUNK):  # windows of one hash are compared word by word
            here, before = order[i : i + CHUNK], order[i - 1 : i - 1 + CHUNK][: len(order[i : i + CHUNK])]
            same = np.flatnonzero(hashes[here] == hashes[before])
            same = same[(self.rows(starts[here[same]])[0] == self.rows(starts[before[same]])[0]).all(axis=1)]
            new[i + same] = False
        run = np.cumsum(new) - 1
        first = starts[order[new]]
        return first, starts[order[~new]], first[run[~new]]

    def firsts(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.mask, count=len(self.symbols)))

    def items_of(self, phrase: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in phrase, item's code) of all items that have these phrases (numbers among firsts(), which start there)."""
        low, high = np.searchsorted(self.more[0], phrase), np.searchsorted(self.more[0], phrase, side="right")
        k = high - low
        return np.concatenate([np.arange(len(phrase)), np.repeat(np.arange(len(phrase)), k)]), np.concatenate([self.codes[self._item(starts)], self.more[1][np.repeat(low, k) + ranges(k)]])


def _find(p: Phrases, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Covered words (boolean) and (document, item) pairs of a shard. symbols: of all words, 0 where unknown; at: each document's range."""
    n, covered = len(symbols), np.zeros(len(symbols), dtype=bool)
    none = np.zeros((0, 2), dtype=np.int64)
    if not n or not p.least:
        return covered, none
    known = symbols > 0
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    first = known.copy()
    first[1:] &= ~known[:-1] | edge[1:n]
    last = known.copy()
    last[:-1] &= ~known[1:] | edge[1:n]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = b - a >= p.least
    a, b = a[long], b[long]
    if not len(a):
        return covered, none
    size = b - a + 1  # with the separator
    start = np.cumsum(size) - size
    x = np.zeros(int(size.sum()), dtype=np.int64)
    place = np.full(len(x), -1, dtype=np.int64)
    inner = np.repeat(start, b - a) + ranges(b - a)
    place[inner] = np.repeat(a, b - a) + ranges(b - a)
    x[inner] = symbols[place[inner]]
    index = FMIndex(x, len(p.vocabulary))
    delta, starts, pairs = np.zeros(n + 1, dtype=np.int64), p.firsts(), [none]
    for i in range(0, len(starts), CHUNK):
        rows, lengths = p.rows(starts[i : i + CHUNK])
        low, high = index.search(rows, lengths)
        count = high - low
        phrase = np.repeat(np.arange(len(low)), count)
        word = place[index.locate(np.repeat(low, count) + ranges(count))]
        np.add.at(delta, word, 1)
        np.add.at(delta, word + lengths[phrase], -1)
        doc = np.searchsorted(at, word, side="right") - 1
        found = np.unique(np.stack([doc, phrase], axis=1), axis=0) if len(doc) else none
        of, item = p.items_of(found[:, 1] + i, starts[found[:, 1] + i])
        pairs.append(np.stack([found[of, 0], item.astype(np.int64)], axis=1))
    covered = np.cumsum(delta[:-1]) > 0
    every = np.concatenate(pairs)
    return covered, np.unique(every, axis=0) if len(every) else none


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _search(found: Phrases, carry: list[str], text: str, shard_bytes: int, cut: bool):
    def shard(pieces: list[pa.RecordBatch], h: Hasher) -> pa.RecordBatch:
        symbols, starts, ends, at = [], [], [], [np.zeros(1, dtype=np.int64)]
        raws = []
        n_words = n_bytes = 0
        for piece in pieces:
            raw, off = flat(piece.column(text))
            a, b, of = words(raw, off, ALNUM)
            w = h.span(h.prefix(h.of_byte[LOWER[raw]]), a, b)
            k = np.searchsorted(found.vocabulary, w)
            ok = k < len(found.vocabulary)
            ok[ok] = found.vocabulary[k[ok]] == w[ok]
            symbols.append(np.where(ok, k + 1, 0))
            at.append(of[1:] + n_words)
            n_words += len(a)
            if cut:
                raws.append((raw, off, a, b, of))
        at = np.concatenate(at)
        covered, pairs = _find(found, np.concatenate(symbols), at)
        total = np.concatenate([[0], np.cumsum(covered)])
        hit = total[at[1:]] - total[at[:-1]]
        edge = np.zeros(n_words + 1, dtype=bool)
        edge[at] = True
        begins, stops = covered.copy(), covered.copy()
        begins[1:] &= ~covered[:-1] | edge[1:n_words]
        stops[:-1] &= ~covered[1:] | edge[1:n_words]
        begins, stops = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        span_at = np.searchsorted(begins, at)
        owner = np.searchsorted(at, begins, side="right") - 1
        spans = pa.ListArray.from_arrays(pa.array(span_at, pa.int32()), pa.StructArray.from_arrays([pa.array(begins - at[owner]), pa.array(stops - at[owner])], fields=list(_SPAN)))
        item_at = np.searchsorted(pairs[:, 0], np.arange(len(at)))
        items = pa.ListArray.from_arrays(pa.array(item_at, pa.int32()), pa.array([found.names[i] for i in pairs[:, 1]], pa.string()))
        columns = [pa.concat_arrays([piece.column(c) for piece in pieces]) for c in carry]
        names = [*carry, "n_words", "n_hit", "spans", "items"]
        columns += [pa.array(np.diff(at)), pa.array(hit), spans, items]
        if cut:
            names.append("clean_text")
            out, base, docs = [], 0, 0
            for piece, (raw, off, a, b, of) in zip(pieces, raws):
                for i, was in enumerate(piece.column(text).to_pylist()):
                    s, e = span_at[docs + i], span_at[docs + i + 1]
                    if s == e:
                        out.append(was)
                        continue
                    kept, cursor = [], off[i]
                    for x, y in zip(begins[s:e] - base, stops[s:e] - base):
                        kept.append(raw[cursor : a[x]].tobytes())
                        cursor = b[y - 1]
                    kept.append(raw[cursor : off[i + 1]].tobytes())
                    out.append(b"".join(kept).decode())
                base += len(a)
                docs += piece.num_rows
            columns.append(pa.array(out, pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, held, size = Hasher(21), [], 0
        for piece in slices(batches, text):
            held.append(piece)
            size += piece.column(text).nbytes
            if size >= shard_bytes:
                yield shard(held, h)
                held, size = [], 0
        if held:
            yield shard(held, h)

    return run


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    carry: Sequence[str] = ("doc_id",),
    text: str = "text",
    window: int = WINDOW,
    cut: bool = False,
    shard_bytes: int = SHARD_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The carried columns with n_words, n_hit, spans (of word numbers) and items;
    with cut also clean_text, without the text from the first to the last word of each span. These replace carried columns of their names.

    benchmark has item_id and text. Words are runs of ASCII letters and digits and all characters beyond ASCII,
    ASCII letters lowered. An item's windows of `window` consecutive words are searched; a shorter
    item is one window, one without words or null none. A null text has no words and its clean_text is null. Items of
    one id count once. A text of any length is searched whole. Without documents there are no rows, without items no hits.

    What is searched for reaches the driver and every task, so the benchmark is dealt into blocks of at most block_bytes of text (one
    item may be longer); of 32 MB of English-like text that is about 30 MB. The driver holds one block at a time: each is read, searched for in one pass over the documents, and
    let go of when the pass's findings are written.
    """
    small_batches(docs.sparkSession)
    new = ["n_words", "n_hit", "spans", "items"] + ["clean_text"] * cut
    at = {c: "__text" if c == text else f"__c{i}" for i, c in enumerate(carry) if c not in new}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in {**at, text: "__text"}.items()])
    typed = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for c, n in at.items())
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"))
    blocks, where = _blocks(items, block_bytes)
    shown = [*[F.col(n).alias(c) for c, n in at.items()], *new]
    if len(blocks) == 1:
        found = f"{typed}n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>" + ", clean_text string" * cut
        return rows.mapInArrow(_search(_phrases(where, blocks[0], window), list(at.values()), "__text", shard_bytes, cut), found).select(*shown)
    return _in_passes(rows, where, blocks, list(at.values()), window, cut, shard_bytes, typed).select(*shown)


#: Parts of the benchmark to a block; blocks are made of whole parts.
PARTS = 64


def _blocks(items: DataFrame, block_bytes: int) -> tuple[list[tuple[int, int]], DataFrame]:
    """First and last part of each block of items, and the items with their part. Of the items only the parts' sizes reach the driver."""
    size = (F.coalesce(F.octet_length("t"), F.lit(0)) + 8).cast("long")
    total = items.agg(F.sum(size)).first()[0] or 0
    if total <= block_bytes:
        return [(0, 0)], items.withColumn("part", F.lit(0))
    parts = PARTS * -(-total // block_bytes)
    dealt = materialize(items.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(parts)).cast("int")), "benchmark")
    blocks: list[tuple[int, int]] = []
    held = 0
    for part, n in dealt.groupBy("part").agg(F.sum(size)).orderBy("part").collect():
        if blocks and held + n <= block_bytes:
            blocks[-1] = (blocks[-1][0], part)
            held += n
        else:
            blocks.append((part, part))
            held = n
    return blocks, dealt


def _phrases(items: DataFrame, block: tuple[int, int], window: int) -> Phrases:
    rows = items.filter(F.col("part").between(*block)).select("i", F.col("t")).toArrow()
    return Phrases(rows.column("i").to_pylist(), rows.column("t").to_pylist(), window)


def _in_passes(docs, items, blocks, carry, window, cut, shard_bytes, typed):
    """A pass for each block, that keeps the texts and is written; spans are merged and cut after the last."""
    kind = "n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>"
    now = docs.select("*", F.array().cast("array<struct<start:long,end:long>>").alias("__spans"), F.array().cast("array<string>").alias("__items"))
    held = [*now.columns]
    more = "" if "__text" in carry else "__text string, "
    more += "__spans array<struct<start:long,end:long>>, __items array<string>"
    last = None
    for block in blocks:
        search = _search(_phrases(items, block, window), held, "__text", shard_bytes, False)
        found = now.mapInArrow(search, f"{typed}{more}, {kind}")
        del search
        done = materialize(found.select(*held[:-2], "n_words", F.concat("__spans", "spans").alias("__spans"), F.array_union("__items", "items").alias("__items")), "pass")
        del found
        if last is not None:
            release(last)
        last, now = done, done.drop("n_words")
    names = [*carry, "n_words", "n_hit", "spans", "items"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            raw, off = flat(batch.column("__text"))
            a, b, of = words(raw, off, ALNUM)
            spans, hits, texts = [], [], []
            for i, (given, was) in enumerate(zip(batch.column("__spans").to_pylist(), batch.column("__text").to_pylist())):
                merged: list[list[int]] = []
                for s, e in sorted((x["start"], x["end"]) for x in given):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                spans.append([{"start": s, "end": e} for s, e in merged])
                hits.append(sum(e - s for s, e in merged))
                if cut and merged:
                    kept, cursor = [], off[i]
                    for s, e in merged:
                        kept.append(raw[cursor : a[of[i] + s]].tobytes())
                        cursor = b[of[i] + e - 1]
                    kept.append(raw[cursor : off[i + 1]].tobytes())
                    was = b"".join(kept).decode()
                texts.append(was)
            columns = [batch.column(c) for c in carry] + [batch.column("n_words"), pa.array(hits, pa.int64()), pa.array(spans, pa.list_(_SPAN)), batch.column("__items")]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(texts, pa.string())] if cut else [])], names=[*names, *(["clean_text"] if cut else [])])

    return last.mapInArrow(merge, f"{typed}{kind}" + ", clean_text string" * cut)


def check_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for every row of documents, repeated ones too; null and empty texts have no words, no hits and the hash of no items."""
    out = decontaminate(docs, benchmark)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = """
WITH up AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents, up),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark, up),
il AS (SELECT item_id, ws, least(10, len(ws)) AS m FROM i WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(ws[s + 1:s + m], ' ') AS p FROM (SELECT item_id, ws, m, unnest(range(0, len(ws) - m + 1)) AS s FROM il)),
ms AS (SELECT DISTINCT m FROM il),
dw AS (SELECT rid, s, m, array_to_string(ws[s + 1:s + m], ' ') AS p
       FROM (SELECT rid, ws, m, unnest(range(0, len(ws) - m + 1)) AS s FROM d, ms WHERE len(ws) >= m)),
h AS (SELECT rid, s, dw.m, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.p = iw.p),
c AS (SELECT rid, count(DISTINCT w) AS n_hit FROM (SELECT rid, unnest(range(s, s + m)) AS w FROM h) GROUP BY rid),
k AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN k USING (rid)
"""
