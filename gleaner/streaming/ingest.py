"""Streaming upsert of postings: at-least-once batches into a keyed store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.functions.keys import store_key
from gleaner.operators import store as S
from gleaner.sources import schema

#: How often a stream is looked at, in the way of the pages it serves.
TRIGGER = "1500 milliseconds"


#: Parts of the store; a batch rewrites those that its keys fall in.
BUCKETS = 64


def postings_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> S.Snapshots:
    return S.Snapshots(spark, path, schema.POSTING, "key", buckets)


def ingest_batch(store: S.Snapshots, sightings: DataFrame) -> None:
    """Upsert one batch. A batch that comes twice changes nothing: fields are chosen by seq, which the source gives.

    An empty batch writes nothing.
    """
    if sightings.isEmpty():
        return
    S.upsert_batch(store, sightings)


def ingest(sightings: DataFrame, store: S.Snapshots, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the store up to date with a stream of sightings."""
    writer = sightings.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: ingest_batch(store, df))
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=TRIGGER).start()


def read_sightings(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of sightings from JSON files, a file for each page."""
    reader = spark.readStream.schema(schema.SIGHTING)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def push(rows: DataFrame, folder: str) -> None:
    """Hand over all rows of a page, not only the new ones; none are handed over as nothing."""
    if not rows.isEmpty():
        rows.write.mode("append").json(folder)


def resend(store: S.Snapshots, folder: str) -> None:
    """Hand over all that is stored; seq stays, so that receivers see nothing new in it."""
    push(store.read().select(*S.FIELDS, "description", "seq", F.lit(None).cast("int").alias("page_no"), F.lit(None).cast("int").alias("pos")), folder)


def missing_in(store: DataFrame, sightings: DataFrame) -> DataFrame:
    return S.added(store, sightings, store_key(F.col("url")))
