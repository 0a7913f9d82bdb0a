"""From cards on captured pages to postings: one row per posting of a page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.keys import page_key
from gleaner.functions.text import few_newlines, present, strip

# A detail text counts from so many characters; a pane is waited for until it has so many.
DETAIL_LENGTH = 300
PANE_LENGTH = 200


def valid(cards: DataFrame) -> DataFrame:
    """Cards with an address and a title."""
    return cards.filter(present(F.col("url")).isNotNull() & present(F.col("title")).isNotNull())


def first_wins(rows: DataFrame, key: Column, order: Column, within: Sequence[str] = ()) -> DataFrame:
    """Of the rows with one key (within the given columns) the first by order, which must be total."""
    w = Window.partitionBy(*within, "__key").orderBy(order)
    return rows.withColumn("__key", key).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__key", "__n")


def collect_cards(cards: DataFrame, page: Sequence[str] = ("page_no",), pos: str = "pos") -> DataFrame:
    """Overlapping selectors give one card twice: valid cards, one for each posting of a page, in card order."""
    return first_wins(valid(cards), page_key(F.col("url")), F.col(pos), page)


def union_cards(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_constants(cards: DataFrame, source: Column, query: Column, description: Column | None = None) -> DataFrame:
    """Postings: transient columns go; source, query and description come."""
    return cards.drop("_el").withColumns({"source": source, "query": query, "description": F.lit("") if description is None else F.coalesce(description, F.lit(""))})


def detail_text(*candidates: Column) -> Column:
    """The first candidate of more than 300 characters, with at most two newlines in a row; else empty."""
    out = F.lit("")
    for c in reversed([strip(F.coalesce(c, F.lit(""))) for c in candidates]):
        out = F.when(F.length(c) > DETAIL_LENGTH, few_newlines(c)).otherwise(out)
    return out


def pane_text(pane: Column) -> Column:
    """A pane's text, however short; the length of 200 only ends the waiting for it."""
    return F.coalesce(strip(pane), F.lit(""))


def pane_ready(pane: Column) -> Column:
    return F.length(pane_text(pane)) > PANE_LENGTH


def visible(cards: DataFrame, page: Sequence[str] = ("page_no",)) -> DataFrame:
    """Number of postings on each page."""
    return collect_cards(cards, page).groupBy(*page).agg(F.count("*").alias("visible"))


def settled(counts: DataFrame, run: str, step: str, n: str, rounds: int = 25, same: int = 2) -> DataFrame:
    """Of each run's counts while a page loads, the step at which it has not changed `same` times in a row, or the
    last of `rounds` steps."""
    w = Window.partitionBy(run).orderBy(step)
    marked = counts.withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= rounds)
    stable = F.lit(True)
    for k in range(1, same + 1):
        stable = stable & (F.col(n) == F.lag(n, k).over(w))
    marked = marked.withColumn("__stable", F.coalesce(stable, F.lit(False)))
    chosen = marked.groupBy(run).agg(F.min(F.when(F.col("__stable"), F.col(step))).alias("__at"), F.max(step).alias("__last"))
    at = chosen.select(run, F.coalesce("__at", "__last").alias(step))
    return marked.join(at, [run, step]).select(run, step, n)
