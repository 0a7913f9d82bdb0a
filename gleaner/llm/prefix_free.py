"""Removal of repeated byte strings by prefix-free parsing.

Texts are dealt in stretches into groups that fit in memory and hold much that repeats (repeats.py says how). In a group, places where a
rolling hash is 0 modulo a number (triggers) cut the stretches into phrases, each from one trigger to the end of the
next. Equal phrases are one entry of the dictionary, and a stretch is the list of its phrases: the parse. No
phrase's suffix that is longer than a trigger is another's prefix. So the suffix array of the dictionary
orders suffixes that differ before their phrase ends, and that of the parse those that don't: together they give
the order of all suffixes, and the common prefixes of neighbours, without sorting the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import MOST, Parsed, Shape, remove_repeats
from .suffixes import Ranks, byte_ranks, deep_nodes
from .units import U, Hasher, flat, ranges

WINDOW = 400
GAP = 128
GRAM = 16
#: Bytes of a trigger, and one in how many places is one.
TRIGGER, MODULUS = 8, 64


class _Bytes:
    def __init__(self):
        self.bytes = Hasher(61)

    def __call__(self, column: pa.Array) -> Parsed:
        raw, off = flat(column)

        def kept(i: int, keep: np.ndarray) -> bytes:
            return raw[off[i] : off[i + 1]][keep].tobytes()

        return Parsed(off, raw, self.bytes.prefix(self.bytes.of_byte[raw]), self.bytes.span, kept)


class Parse:
    """Stretches of bytes (first: where each begins; size) as phrases of a dictionary; starts: the bytes whose suffixes are to be put in order.

    A stretch's last phrase ends with the stretch, and is never taken for one that ends with a trigger."""

    def __init__(self, raw: np.ndarray, first: np.ndarray, size: np.ndarray, starts: np.ndarray, trigger: int = TRIGGER, modulus: int = MODULUS):
        self.trigger, n = trigger, len(raw)
        self.hash = Hasher(62)
        self.sums = self.hash.prefix(self.hash.of_byte[raw])
        last = np.repeat(first + size, size)
        a = np.arange(max(0, n - trigger + 1))
        cut = (self.hash.span(self.sums, a, a + trigger) % U(modulus) == 0) & (a + trigger <= last[: len(a)])
        head = np.zeros(n, dtype=bool)
        head[a[cut]] = True
        head[first] = True
        self.of = np.cumsum(head) - 1  # each byte's phrase
        self.begin = np.flatnonzero(head)  # of each phrase; it ends with the next one's trigger, or the stretch
        ends = last[self.begin]
        after = np.r_[self.begin[1:], n]
        self.final = after >= ends
        self.end = np.where(self.final, ends, after + trigger)
        # The dictionary: one of each phrase, in order.
        key = self.hash.span(self.sums, self.begin, self.end) ^ (self.final.astype(U) * U(0x9E3779B97F4A7C15))
        _, one, phrase = np.unique(key, return_index=True, return_inverse=True)
        view = raw.tobytes()
        entries = [view[x:y] for x, y in zip(self.begin[one].tolist(), self.end[one].tolist())]
        order = np.array(sorted(range(len(entries)), key=entries.__getitem__), dtype=np.int64)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        # Its suffix array, of the entries in which a suffix begins.
        self.phrase = rank[phrase]
        asked = np.zeros(len(order), dtype=bool)
        asked[self.phrase[self.of[starts]]] = True
        one = one[order]
        long = np.where(asked, self.end[one] - self.begin[one], 0)
        self.at = np.cumsum(long) - long  # of each entry in what is sorted
        self.suffixes = byte_ranks(raw[np.repeat(self.begin[one], long) + ranges(long)], np.repeat(self.at + long, long))
        # The parse, in which each phrase is its entry's number.
        there = self.of[first + size - 1] + 1 if len(first) else np.zeros(0, dtype=np.int64)
        self.list_end = np.repeat(there, np.diff(np.r_[0, there]))
        net = self.end - self.begin - np.where(self.final, 0, trigger)
        self.before = np.r_[0, np.cumsum(net)]
        self.parse = Ranks(self.phrase, self.list_end, int(np.diff(np.r_[0, there]).max()) if len(there) else 1)

    def rest(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the suffixes at bytes i: the rank of the rest of their phrase; and the phrase."""
        k = self.of[i]
        return self.suffixes[self.at[self.phrase[k]] + i - self.begin[k]], k

    def order(self, i: np.ndarray) -> np.ndarray:
        """The places i in the order of their suffixes: by the dictionary's suffix array, then by the parse's for what follows the phrase."""
        rest, k = self.rest(i)
        follows = np.where(self.final[k], -1, np.r_[self.parse.rank, 0][k + 1])
        return i[np.lexsort((follows, rest))]

    def _alike(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes from a and b on are the same, at most so many: by halving, with rolling hashes."""
        low, high = np.zeros(len(a), dtype=np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.hash.span(self.sums, a, a + mid) == self.hash.span(self.sums, b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at i and j, neighbours in order or not."""
        (x, k), (y, m) = self.rest(i), self.rest(j)
        out = np.where((x == y) & self.final[k], self.end[k] - i, 0)
        other = np.flatnonzero(x != y)  # they differ before their phrases end, or one's stretch ends
        a, b = i[other], j[other]
        out[other] = self._alike(a, b, np.minimum(self.end[k[other]] - a, self.end[m[other]] - b))
        # The same rest of a phrase: the trigger at its end begins the next phrase.
        on = np.flatnonzero((x == y) & ~self.final[k])
        a, b = k[on] + 1, m[on] + 1
        c = np.where(a == b, 0, self.parse.common(a, b))
        out[on] = self.end[k[on]] - i[on] - self.trigger + self.before[a + c] - self.before[a]
        more = (a + c < self.list_end[k[on]]) & (b + c < self.list_end[m[on]])
        a, b = (a + c)[more], (b + c)[more]
        out[on[more]] += self._alike(self.begin[a], self.begin[b], np.minimum(self.end[a] - self.begin[a], self.end[b] - self.begin[b]))
        return out


def repeated(raw: np.ndarray, first: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """For each window whether its string starts elsewhere too. first, windows: of each stretch of bytes."""
    starts = np.repeat(first, windows) + ranges(windows)
    parse = Parse(raw, first, windows + length - 1, starts)
    places = parse.order(starts)
    common = np.r_[0, parse.common(places[:-1], places[1:])] if len(places) else np.zeros(0, dtype=np.int64)
    low, high, _ = deep_nodes(common, length)
    deep = np.zeros(len(raw), dtype=bool)
    deep[places[np.repeat(low, high - low) + ranges(high - low)]] = True
    return deep[starts]


def remove_repeated_bytes(
    docs: DataFrame, carry: Sequence[str] = ("doc_id",), text: str = "text", window: int = WINDOW, keep_text: bool = True, most: int = MOST
) -> DataFrame:
    """The carried columns with n_units (bytes), n_removed, spans (of byte
    numbers, ends excluded), kept_sha256 and kept (the bytes that stay; null without keep_text), which replace carried ones of these names.

    A byte goes if a string of `window` bytes that covers it also starts elsewhere, in this text or another;
    strings are judged on the input. Null is empty. Repeated rows repeat each other's strings. A text of any length is read whole. An empty
    table gives no rows. Phrases are known by 64-bit hashes. A removal may split a character. most: stretches of a prefix that one task puts in order.
    """
    gram = min(GRAM, window)
    return remove_repeats(docs, _Bytes, Shape(window, max(1, min(GAP, window - gram)), gram, 1, most), repeated, list(carry), text, keep_text)


def dedup_documents(docs: DataFrame) -> DataFrame:
    """One row for every row of documents; null and empty texts have no bytes and keep the hash of nothing."""
    out = remove_repeated_bytes(docs.select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT rid, s, md5(substring(h, 2 * s + 1, {2 * WINDOW})) AS p FROM (SELECT rid, h, unnest(range(0, CAST(len(h) // 2 AS BIGINT) - {WINDOW - 1})) AS s FROM d WHERE len(h) >= {2 * WINDOW})),
r AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY p) AS c FROM g) WHERE c > 1),
f AS (SELECT rid, s, CASE WHEN s - lag(s) OVER (PARTITION BY rid ORDER BY s) <= {WINDOW} THEN 0 ELSE 1 END AS new FROM r),
n AS (SELECT rid, s, sum(new) OVER (PARTITION BY rid ORDER BY s) AS run FROM f),
x AS (SELECT rid, run, min(s) AS a, max(s) + {WINDOW} AS b FROM n GROUP BY rid, run),
y AS (SELECT rid, run, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY run), 0) AS before FROM x),
k AS (SELECT y.rid, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY run) AS t FROM y JOIN d ON y.rid = d.rid GROUP BY y.rid)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(concat(coalesce(t, ''), substring(h, 2 * coalesce(last, 0) + 1, len(h))))) AS kept_sha256
FROM d LEFT JOIN k ON d.rid = k.rid
"""
