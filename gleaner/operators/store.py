"""The keyed table of postings, and the list of those applied to.

The store is a folder of snapshots with a pointer to the current one: a snapshot
is never overwritten while it is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.shared import placed
from gleaner.functions.keys import store_key
from gleaner.functions.text import present

FIELDS = ("title", "company", "location", "url", "source", "query")


def latest(sightings: DataFrame, key: Column, seq: str = "seq", fields: Sequence[str] = FIELDS) -> DataFrame:
    """One row per key (empty keys don't count): every field as last given, empty
    text included, but the description as last given and not empty. first_seq is the first sighting's.

    A grouped aggregate with partial sums: a key seen very often is no large group anywhere.
    """
    rows = sightings.withColumn("key", key).filter(F.col("key") != "")
    d = present(F.col("description"))
    return rows.groupBy("key").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(seq))).alias(f) for f in fields],
        F.coalesce(F.max_by(d, F.when(d.isNotNull(), F.col(seq))), F.lit("")).alias("description"),
        F.max(seq).alias("seq"),
        F.min(F.coalesce("first_seq", seq) if "first_seq" in sightings.columns else F.col(seq)).alias("first_seq"),
    )


def upsert(store: DataFrame, sightings: DataFrame, key: Column | None = None, fields: Sequence[str] = FIELDS) -> DataFrame:
    """The store with new sightings. Their seq must be above the store's."""
    both = store.select(*fields, "description", "seq", "first_seq").unionByName(
        sightings.select(*fields, "description", "seq", F.col("seq").alias("first_seq"))
    )
    return latest(both, store_key(F.col("url")) if key is None else key, fields=fields)


def added(store: DataFrame, sightings: DataFrame, key: Column) -> DataFrame:
    """Keys that the store lacks, each once."""
    return sightings.select(key.alias("key")).filter("key <> ''").distinct().join(store.select("key"), "key", "left_anti")


def totals(store: DataFrame) -> DataFrame:
    """Numbers of postings, and of those with a description."""
    return store.agg(F.countDistinct("key").alias("total"), F.count(present(F.col("description"))).alias("with_description"))


def not_applied(postings: DataFrame, applied: DataFrame, on: Sequence[str] = ("url",)) -> DataFrame:
    return postings.join(applied.select(*on), list(on), "left_anti")


def insert_applied(applied: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the list with new addresses, how many were added). urls: url, seq."""
    new = urls.groupBy("url").agg(F.min("seq").alias("first_seq")).join(applied.select("url"), "url", "left_anti")
    return applied.unionByName(new.select("url", "first_seq")), new.agg(F.count("*").alias("added"))


def envelope(store: DataFrame, at: Column) -> DataFrame:
    """Postings as JSON lines in first-seen order, for an export that the caller writes; see write_export for the whole envelope."""
    names = [*FIELDS, "description"]
    return store.orderBy("first_seq").select(F.to_json(F.struct(*names)).alias("job"), at.cast("string").alias("exported_at"))


def whole_envelope(store: DataFrame, at: Column) -> DataFrame:
    """The export as one row: `{exported_at, count, jobs}` as JSON, jobs in first-seen order. One row holds all postings, as whoever asks for
    it wants one text; write_export gives a store of any size in parts."""
    job = F.struct(*FIELDS, "description")
    one = store.agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.struct("first_seq", "key", job.alias("job")))).alias("j"))
    return one.select(F.to_json(F.struct(at.cast("string").alias("exported_at"), "count", F.transform("j", lambda x: x["job"]).alias("jobs"))).alias("envelope"))


def envelope_parts(store: DataFrame, at: Column, size: int = 1000) -> DataFrame:
    """The export in envelopes of `size` postings, the last of fewer: part (from 0), count (of the whole store) and envelope, `{exported_at, count, jobs}` as JSON with jobs in first-seen
    order, part after part. For stores of any size: no row holds more than a part. An empty store has no parts."""
    total = store.count()
    numbered = placed(store, [F.col("first_seq").asc_nulls_first(), F.col("key").asc()])
    part = F.expr(f"(place - 1) div {size}").alias("part")
    jobs = F.array_sort(F.collect_list(F.struct("place", F.struct(*FIELDS, "description").alias("job"))))
    whole = F.struct(at.cast("string").alias("exported_at"), F.lit(total).alias("count"), F.transform("j", lambda x: x["job"]).alias("jobs"))
    return numbered.groupBy(part).agg(jobs.alias("j")).select("part", F.lit(total).alias("count"), F.to_json(whole).alias("envelope"))


def write_export(store: DataFrame, path: str, at: str) -> None:
    """The export as a folder: postings in parts of JSON lines, in first-seen order, and a head with time and
    number. No row holds all postings."""
    names = [*FIELDS, "description"]
    store.orderBy("first_seq").select(*names).write.mode("errorifexists").json(f"{path}/jobs")
    store.agg(F.count("*").alias("count")).select(F.lit(at).alias("exported_at"), "count").write.mode("errorifexists").json(f"{path}/head")


class Snapshots:
    """A table in a folder that any number of readers and one writer share.

    key, buckets: rows are kept in so many parts by a hash of their key, and an update rewrites the parts that it
    touches. The pointer names each part's folder, and is written last."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str | None = None, buckets: int = 1):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets if key else 1

    def _pointers(self) -> DataFrame:
        return self.spark.read.schema("version long, bucket int, folder string").json(f"{self.path}/pointer")

    def _fs(self, folder: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, folder: str) -> bool:
        fs, p = self._fs(folder)
        return fs.exists(p)

    def _current(self) -> tuple[int, dict[int, str]]:
        """The version and the folders of its parts."""
        if not self._exists(f"{self.path}/pointer"):
            return 0, {}
        all_of = self._pointers()
        last = all_of.agg(F.max("version")).first()[0]
        rows = all_of.filter(F.col("version") == last).collect() if last else []
        return last or 0, {r["bucket"]: r["folder"] for r in rows if r["folder"]}

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The current snapshot, or some parts of it; no rows before the first."""
        _, folders = self._current()
        wanted = [f for b, f in sorted(folders.items()) if buckets is None or b in buckets]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in wanted])

    def _write(self, df: DataFrame, version: int, kept: dict[int, str]) -> None:
        columns = self.spark.createDataFrame([], self.schema).columns
        folder = f"snapshot-{version}-{uuid.uuid4().hex[:8]}"
        part = self.bucket(F.col(self.key)) if self.buckets > 1 else F.lit(0)
        rows = df.select(*columns, part.alias("part"))
        (rows.repartition("part") if self.buckets > 1 else rows).write.partitionBy("part").parquet(f"{self.path}/{folder}")
        fs, p = self._fs(f"{self.path}/{folder}")
        made = [x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()]
        found = kept | {int(n.partition("=")[2]): f"{folder}/{n}" for n in made if n.startswith("part=")}
        lines = [(version, b, f) for b, f in sorted(found.items())] or [(version, None, None)]
        self.spark.createDataFrame(lines, "version long, bucket int, folder string").coalesce(1).write.mode("append").json(f"{self.path}/pointer")

    def replace(self, df: DataFrame) -> None:
        """Write df, which may be built from read(), as the next snapshot. Earlier ones stay as archives."""
        self._write(df, self._current()[0] + 1, {})

    def update(self, keys: DataFrame, build: Callable[[DataFrame], DataFrame]) -> None:
        """Write build(rows) in place of the rows of all parts that hold one of the keys; the other parts stay as they are. At most as
        many numbers as there are parts reach the driver."""
        version, folders = self._current()
        touched = {r[0] for r in keys.select(self.bucket(F.col(self.key)) if self.buckets > 1 else F.lit(0)).distinct().collect()}
        self._write(build(self.read(sorted(touched))), version + 1, {b: f for b, f in folders.items() if b not in touched})

    def reset(self) -> int:
        """Empty the table; what was there stays archived. Returns how many rows that were."""
        n = self.read().count()
        self.replace(self.spark.createDataFrame([], self.schema))
        return n


def upsert_batch(store: Snapshots, sightings: DataFrame) -> None:
    """Upsert sightings into a store of postings by key."""
    keyed = sightings.select(store_key(F.col("url")).alias("key")).filter("key <> ''")
    store.update(keyed, lambda rows: upsert(rows, sightings))
