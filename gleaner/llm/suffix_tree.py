"""Removal of repeated runs of words by prefix-partitioned suffix trees.

Suffixes are dealt by prefixes of varying length into groups that fit in memory (repeats.py says how). Each
group's suffix tree is held as its suffix array with the common prefixes of neighbours; the intervals whose common prefix reaches the
window's length are the tree's deep inner nodes, and their leaves are the starts of repeated passages.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import MOST, Parsed, Shape, remove_repeats
from .suffixes import Ranks, deep_nodes
from .units import NOT_BLANK, Hasher, flat, ranges, words

WINDOW = 35
GAP = 20
GRAM = 3
#: Bytes of a word's hash in a group, whose suffixes agree in 16 words anyway.
WIDE = 5


class _Words:
    """Words between ASCII blanks as units; a word is known by a 64-bit hash."""

    def __init__(self):
        self.bytes, self.units = Hasher(51), Hasher(52)

    def __call__(self, column: pa.Array) -> Parsed:
        raw, off = flat(column)
        a, b, at = words(raw, off, NOT_BLANK)
        w = self.bytes.span(self.bytes.prefix(self.bytes.of_byte[raw]), a, b)
        view = memoryview(raw)

        def kept(i: int, keep: np.ndarray) -> bytes:
            mine = slice(at[i], at[i + 1])
            return b" ".join(view[x:y] for x, y in zip(a[mine][keep].tolist(), b[mine][keep].tolist()))

        return Parsed(at, w, self.units.prefix(w), self.units.span, kept)


def subtree(units: np.ndarray, first: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix tree of the suffixes that start windows: their places in order, and first leaf, end and depth of its uppermost nodes that are `length` deep or more.
    first, windows: of each stretch of units."""
    size = windows + length - 1
    tree = Ranks(units, np.repeat(first + size, size), length)
    places = np.repeat(first, windows) + ranges(windows)
    places = places[np.argsort(tree.rank[places], kind="stable")]
    common = np.r_[0, tree.common(places[:-1], places[1:])] if len(places) else np.zeros(0, dtype=np.int64)
    return places, *deep_nodes(common, length)


def below_deep_nodes(units: np.ndarray, first: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """For each window whether its suffix is a leaf below a deep node."""
    places, low, high, _ = subtree(units, first, windows, length)
    deep = np.zeros(len(units), dtype=bool)
    deep[places[np.repeat(low, high - low) + ranges(high - low)]] = True
    return deep[np.repeat(first, windows) + ranges(windows)]


def remove_repeated_words(
    docs: DataFrame, carry: Sequence[str] = ("doc_id",), text: str = "text", window: int = WINDOW, keep_text: bool = True, most: int = MOST
) -> DataFrame:
    """The carried columns with n_units (words), n_removed, spans (of word
    numbers, ends excluded), kept_sha256 and kept (the kept words joined by one space, UTF-8; null without keep_text), which replace carried ones of these names.

    A word goes if a window of `window` words that covers it also starts elsewhere, in this
    text or another; windows are judged on the input. Null and empty texts have no words. Repeated rows repeat
    each other's windows. A text of any length is read whole. An empty table gives no rows.
    Words are compared by 64-bit hashes, in groups by 40 of these bits. most: stretches of a prefix that one task puts in order.
    """
    gap = max(1, min(GAP, window - GRAM))
    return remove_repeats(docs, _Words, Shape(window, gap, min(GRAM, window), WIDE, most), below_deep_nodes, list(carry), text, keep_text)


def dedup_documents(docs: DataFrame) -> DataFrame:
    """One row for every row of documents; null and empty texts have no words and keep the hash of nothing."""
    out = remove_repeated_words(docs.select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT rid, s, array_to_string(ws[s + 1:s + {WINDOW}], ' ') AS p
      FROM (SELECT rid, ws, unnest(range(0, len(ws) - {WINDOW - 1})) AS s FROM d WHERE len(ws) >= {WINDOW})),
r AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY p) AS c FROM g) WHERE c > 1),
gone AS (SELECT DISTINCT rid, unnest(range(s, s + {WINDOW})) AS w FROM r),
u AS (SELECT rid, doc_id, len(ws) AS n, unnest(ws) AS x, unnest(range(0, len(ws))) AS w FROM d),
k AS (SELECT u.rid, count(gone.w) AS n_removed, string_agg(CASE WHEN gone.w IS NULL THEN x END, ' ' ORDER BY u.w) AS t
      FROM u LEFT JOIN gone ON u.rid = gone.rid AND u.w = gone.w GROUP BY u.rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
