"""What the pages' and the service's messages and the command lines do, as functions over tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import keys, text
from gleaner.operators import batch, collect, gate, layout, store
from gleaner.sources import html, payloads, schema


def collect_pages(pages: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Postings of captured list pages (url, html, page_no). Cards are deduplicated before the
    details (url, html of posting pages) are read, and only the details of what is left are."""
    cards = collect.collect_cards(html.scan_cards(pages))
    if details is None:
        return collect.with_constants(cards, F.col("source"), F.col("query"))
    key = keys.page_key(F.col("url"))
    wanted = details.withColumn("__key", key).join(cards.select(key.alias("__key")).distinct(), "__key", "left_semi")
    # Of several details of a posting the longest text, then one by a hash of its address.
    best = F.struct(F.length("description"), F.expr("-xxhash64(url)"), F.col("description"))
    read = html.scan_details(wanted.drop("__key")).groupBy(key.alias("__key")).agg(F.max(best)["description"].alias("description"))
    joined = cards.withColumn("__key", key).join(read, "__key", "left").drop("__key")
    return collect.with_constants(joined, F.col("source"), F.col("query"), F.col("description"))


@dataclass
class Service:
    """The tables behind the five operations: status, push, applied, built, reset."""

    spark: SparkSession
    path: str
    buckets: int = 16

    def __post_init__(self):
        self.postings = store.Snapshots(self.spark, f"{self.path}/postings", schema.POSTING, "key", self.buckets)
        self.applied_list = store.Snapshots(self.spark, f"{self.path}/applied", schema.APPLIED)
        self.built_index = store.Snapshots(self.spark, f"{self.path}/built", schema.BUILT)
        self.last_push = store.Snapshots(self.spark, f"{self.path}/last_push", schema.LAST_PUSH)
        self.searches = store.Snapshots(self.spark, f"{self.path}/searches", schema.SAVED_SEARCH)

    def push(self, sightings: DataFrame) -> dict:
        """Upsert; nothing happens without rows."""
        if sightings.isEmpty():
            return {"ok": True, "added": 0}
        n = store.added(self.postings.read(), sightings, keys.store_key(F.col("url"))).count()
        store.upsert_batch(self.postings, sightings)
        self.last_push.replace(sightings.agg(F.max("seq").alias("seq"), F.count("*").alias("sent"), F.lit(n).cast("bigint").alias("added")))
        return {"ok": True, "added": n, **store.totals(self.postings.read()).first().asDict()}

    def save_search(self, search: DataFrame) -> None:
        """Keep one search (of the saved search's schema) in place of the one before."""
        self.searches.replace(search.limit(1))

    def applied(self, urls: DataFrame) -> dict:
        listed, n = store.insert_applied(self.applied_list.read(), urls)
        added = n.first()["added"]
        if added:
            self.applied_list.replace(listed)
        now = self.applied_list.read()
        return {"ok": True, "added": added, "total": now.count(), "matches": store.not_applied(self.postings.read(), now).count()}

    def built(self) -> DataFrame:
        return self.built_index.read()

    def status(self, day_begins: int | None = None) -> DataFrame:
        """One row of the status schema. day_begins: the first seq of today; without it, what was collected today is null. The latest report is the one of
        the last date under `reports`; matches are postings not applied to."""
        latest = self.built().agg(F.count("*").alias("built"), F.max("date").alias("latest_batch"))
        now = self.postings.read()
        today = None if day_begins is None else now.filter(F.col("first_seq") >= day_begins).count()
        applied = self.applied_list.read()
        matches = store.not_applied(now, applied).count() if now.take(1) else None
        return latest.select(
            F.lit(applied.count()).alias("applied"), F.lit(today).cast("bigint").alias("collected_today"), "built", "latest_batch",
            F.lit(self._latest_report()).cast("string").alias("latest_report"), F.when(F.lit(matches is not None), F.struct(F.lit(matches).cast("bigint").alias("matches"))).alias("last_rank"),
        )

    def _latest_report(self) -> str | None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/reports")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return max(names, default=None)

    def reset(self) -> dict:
        """Empties the postings, which stay archived; the applied list is not touched."""
        return {"ok": True, "archived": self.postings.reset()}


def current(pages: DataFrame) -> DataFrame:
    """(url, current_url) of pages that show a posting."""
    return pages.select("url", keys.current_job(F.col("url")).alias("current_url")).filter("current_url IS NOT NULL")


def status_line(status: DataFrame) -> DataFrame:
    return status.select(text.status_text(F.col("collected_today"), F.col("applied"), F.col("last_rank.matches")).alias("line"))


def report_command(spark: SparkSession, source: str, target: str, date: str | None = None) -> int:
    """Write a batch's page. 1 if the payload is not there."""
    date = date or dt.date.today().isoformat()
    p = spark._jvm.org.apache.hadoop.fs.Path(source)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return 1
    pages = batch.report(payloads.parse_batch(payloads.raw_payloads(spark, source), date))
    pages.select("html").coalesce(1).write.mode("overwrite").text(target)
    return 0


def gate_command(spark: SparkSession, paths: list[str]) -> tuple[int, DataFrame | None]:
    """(0 without problems, 1 with some, 2 without paths; the problems). Paths that are not there are problems."""
    if not paths:
        return 2, None
    fs = spark._jvm.org.apache.hadoop.fs

    def there(p: str) -> bool:
        path = fs.Path(p)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    found = [p for p in paths if there(p)]
    absent = [(p, "not_found", f"{p}: not found") for p in paths if p not in found]
    out = spark.createDataFrame(absent, "path string, rule string, problem string")
    if found:
        cvs = payloads.parse_cv(payloads.raw_payloads(spark, found))
        out = out.unionByName(gate.problems(cvs, gate.labels(gate.bullets(cvs))))
    return (0 if out.isEmpty() else 1), out


def layout_command(spark: SparkSession, kind: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the layout, forbidden dashes). Any kind but cv is a letter."""
    raw = payloads.raw_payloads(spark, source)
    bad = raw.select("path", gate.forbidden_dash(F.col("raw")).alias("dash")).filter("dash IS NOT NULL")
    rows = layout.cv(payloads.parse_cv(raw)) if kind == "cv" else layout.letter(payloads.parse_letter(raw))
    return rows, bad
