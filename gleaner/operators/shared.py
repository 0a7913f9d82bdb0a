"""Tables that a plan writes for itself, rows in an order that no task holds whole, and the size of batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PLACE = 33  # bits of a row's place in its partition, as monotonically_increasing_id() has them
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset a folder in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return found.rstrip("/") if found else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_gleaner"


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands texts to Python in batches of 8 MB at most: 10,000 rows, which Spark puts in a batch, may be any number of bytes. A
    lower bound that the session has stays."""
    now = spark.conf.get(_BATCH, None)
    if now is None or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt over as many tasks as a shuffle has, by keys: for small tables that take long a row, since a file of a few MB is one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: a lost executor costs no more than the tasks that come after it."""
    path = f"{shared_dir(df.sparkSession)}/gleaner-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """rows as a written table whose parts follow each other in `order`, with __part and __off (the place in the part). Rows that tie go on in any order and may be in
    several parts, so that no value makes a part large."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*order, F.col("__salt").asc()]
    placed = rows.withColumn("__salt", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by).drop("__salt")
    placed = written(placed.withColumn("__at", F.monotonically_increasing_id()), name)
    return placed.withColumns({"__part": F.shiftright("__at", _PLACE), "__off": F.col("__at").bitwiseAND((1 << _PLACE) - 1)}).drop("__at")


def running(rows: DataFrame, keys: Sequence[str], value: str, how: Callable[[str], Column], name: str, before: bool = False) -> DataFrame:
    """rows of in_order() with `name`: the sum or maximum (how: F.sum, F.max) of value over the rows of its keys so far (before: without the row itself), null where there are none. Parts hand on what
    they come to; a task holds a key's rows of one part, or one row for each part."""
    here = Window.partitionBy("__part", *keys).orderBy("__off").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    of_part = rows.groupBy(*keys, "__part").agg(how(value).alias("__of_part"))
    handed = of_part.select(*keys, "__part", how("__of_part").over(earlier).alias("__handed")).filter("__handed IS NOT NULL")
    inside = rows.withColumn("__in", how(value).over(here)).join(handed, [*keys, "__part"], "left")
    both = F.greatest("__in", "__handed") if how is F.max else F.coalesce(F.col("__in") + F.col("__handed"), "__in", "__handed")
    return inside.withColumn(name, both).drop("__in", "__handed")


def placed(rows: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """rows with `name`, their place in the order, from 1 on: the place in a part and the rows of the parts before it, of which a task sees the numbers only."""
    parts = in_order(rows, order, "places")
    ends = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each part
    ends = ends.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return parts.join(F.broadcast(ends), "__part").withColumn(name, F.col("__before") + F.col("__off") + 1).drop("__part", "__off", "__before")


def micros(at: str) -> Column:
    """A timestamp column, with or without a time zone, as microseconds on its own clock."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({at} AS TIMESTAMP_NTZ))")
