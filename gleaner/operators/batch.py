"""Batches of roles: cards, order, filter and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.shared import placed
from gleaner.functions.text import base_name, escape_html, haystack, list_text, present, unnamed

LAST_RANK = 99


def cards(batches: DataFrame) -> DataFrame:
    """One row per built role, in input order: date, input_pos, the role's fields, has_url, why_text, n_flags, files that
    have a path, and haystack. Null flags and files are none."""
    r = batches.select("date", F.posexplode("built").alias("input_pos", "r")).select("date", "input_pos", "r.*")
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    files = F.filter(F.coalesce("files", F.array().cast("array<struct<label:string,path:string>>")), lambda f: F.coalesce(f["path"], F.lit("")) != "")
    return r.select(
        "date", "input_pos", "rank", "company", "title", "location", F.coalesce("url", F.lit("")).alias("url"), "why", flags.alias("flags"), files.alias("files"),
        present(F.col("url")).isNotNull().alias("has_url"), F.coalesce(present(F.col("why")), F.lit("no rationale recorded")).alias("why_text"),
        F.size(flags).alias("n_flags"), haystack([F.col(c) for c in ("title", "company", "location", "why")], flags).alias("haystack"),
    )


def dropped(batches: DataFrame) -> DataFrame:
    return batches.select("date", F.posexplode("dropped").alias("input_pos", "d")).select("date", "input_pos", "d.company", "d.title", "d.reason")


def sizes(batches: DataFrame) -> DataFrame:
    """Numbers of built and dropped roles; the pool's size where it is not 0."""
    return batches.select("date", F.size("built").alias("n_built"), F.size("dropped").alias("n_dropped"), F.nullif("pool_size", F.lit(0)).alias("pool"))


def ranked(roles: DataFrame, pos: str = "input_pos") -> DataFrame:
    """By rank; none and 0 come as 99; ties stay in input order."""
    return roles.withColumn("rank_key", F.coalesce(F.nullif(F.col("rank"), F.lit(0)), F.lit(LAST_RANK))).orderBy("rank_key", pos)


def rank_places(roles: DataFrame, pos: str = "input_pos") -> DataFrame:
    """ranked() with each role's place, from 1 on, for lists of any length."""
    return placed(roles.withColumn("rank_key", F.coalesce(F.nullif(F.col("rank"), F.lit(0)), F.lit(LAST_RANK))), [F.col("rank_key").asc(), F.col(pos).asc()])


def top(roles: DataFrame, k: int = 5, pos: str = "input_pos") -> DataFrame:
    return ranked(roles, pos).limit(k)


def batch_list(built: DataFrame, date: str) -> DataFrame:
    """Companies of one day's batch, as ranked."""
    return ranked(built.filter(F.col("date") == date), "key").select(unnamed(F.col("company")).alias("company"), "rank_key", "key")


def matching(roles: DataFrame, query: Column | str) -> DataFrame:
    """Roles whose haystack holds the query, trimmed and lowered; all for an empty one."""
    q = F.lower(F.trim(F.lit(query) if isinstance(query, str) else query))
    return roles.filter((q == "") | F.contains("haystack", q))


def built_flag(jobs: DataFrame, built: DataFrame, key: Column) -> DataFrame:
    """jobs with date and rank of their documents, null where none are built. Spark broadcasts the built side where it is small."""
    b = built.select(F.col("key").alias("__key"), F.col("date").alias("built_date"), F.col("rank").alias("built_rank"))
    return jobs.join(b, key == F.col("__key"), "left").drop("__key")


# Fixed values, here and in report(): class names, data attributes and wordings of cards and pages.
def card_html() -> Column:
    """A card as a fragment of a page."""
    e = escape_html
    col = F.col
    link = F.concat(F.lit('<a class="title" href="'), e(col("url")), F.lit('">'), e(col("title")), F.lit("</a>"))
    title = F.when(col("has_url"), link).otherwise(F.concat(F.lit('<span class="title">'), e(col("title")), F.lit("</span>")))
    flags = list_text(F.transform("flags", lambda f: F.concat(F.lit("<li>"), e(f), F.lit("</li>"))), "")
    files = list_text(F.transform("files", lambda f: F.concat(F.lit('<a href="'), e(f["path"]), F.lit('" download="'), e(base_name(f["path"])), F.lit('">'), e(f["label"]), F.lit("</a>"))), "")
    posting = F.when(col("has_url"), F.concat(F.lit('<a href="'), e(col("url")), F.lit('">posting</a>'))).otherwise("")
    return F.concat(
        F.lit('<article class="card" data-url="'), e(col("url")), F.lit('" data-search="'), e(col("haystack")), F.lit('"><span class="rank">'), e(col("rank")), F.lit("</span>"),
        title, F.lit('<span class="org">'), e(col("company")), F.lit(" · "), e(col("location")), F.lit('</span><p class="why">'), e(col("why_text")), F.lit("</p>"),
        F.when(flags != "", F.concat(F.lit('<ul class="flags">'), flags, F.lit("</ul>"))).otherwise(""),
        F.lit('<div class="files">'), files, posting, F.lit("</div></article>"),
    )


def report(batches: DataFrame) -> DataFrame:
    """(date, html): a page for each batch. All text is escaped, the date too. A batch is one row already, so its cards are
    brought together in that row's group only."""
    e = escape_html
    fragments = cards(batches).select("date", F.struct("input_pos", card_html().alias("html")).alias("c")).groupBy("date").agg(F.array_sort(F.collect_list("c")).alias("c"))
    out = dropped(batches).select(
        "date", F.struct("input_pos", F.concat(F.lit("<tr><td>"), e(F.col("company")), F.lit("</td><td>"), e(F.col("title")), F.lit("</td><td>"), e(F.col("reason")), F.lit("</td></tr>")).alias("html")).alias("d")
    ).groupBy("date").agg(F.array_sort(F.collect_list("d")).alias("d"))
    n = sizes(batches).join(batches.select("date", "note"), "date")
    rows = n.join(fragments, "date", "left").join(out, "date", "left")
    text = lambda c: list_text(F.transform(c, lambda x: x["html"]), "\n")
    pool = F.coalesce(F.concat(F.lit(" from a pool of "), F.col("pool").cast("string")), F.lit(""))
    table = F.when(
        F.col("n_dropped") > 0,
        F.concat(F.lit("<h2>Not built</h2><p>"), F.col("n_dropped").cast("string"), F.lit(" considered and left out</p><table>"), text("d"), F.lit("</table>")),
    ).otherwise("")
    return rows.select(
        "date",
        F.concat(
            F.lit('<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>Batch '), e(F.col("date")), F.lit("</title></head><body><h1>Batch "), e(F.col("date")),
            F.lit("</h1><p>"), F.col("n_built").cast("string"), F.lit(" built"), pool, F.lit("</p>\n"),
            F.when(F.col("n_built") > 0, text("c")).otherwise('<p class="empty">Nothing was built in this batch.</p>'),
            F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit('<p class="note">'), e(F.col("note")), F.lit("</p>"))).otherwise(""), table, F.lit("</body></html>\n"),
        ).alias("html"),
    )
