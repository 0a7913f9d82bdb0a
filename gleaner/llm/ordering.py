"""Places of rows in an order that no task sees whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

_PLACE = 33  # bits of the place in a part, as monotonically_increasing_id() has them


def in_parts(rows: DataFrame, order: Sequence[Column], name: str, parts: int = 0) -> DataFrame:
    """rows as a written table in parts that follow each other in `order`, with __part and __off, the row's place in its part. Rows that tie go on in any
    order, and are dealt to several parts too, so that no value makes a part large. parts: how many there are at least."""
    n = max(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("__salt", F.monotonically_increasing_id())
    by = [*order, F.col("__salt").asc()]
    placed = dealt.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("__salt").withColumn("__at", F.monotonically_increasing_id())
    return materialize(placed, name).withColumns({"__part": F.shiftright("__at", _PLACE), "__off": F.col("__at").bitwiseAND((1 << _PLACE) - 1)}).drop("__at")


def numbered(rows: DataFrame, group: str, order: Sequence[Column], name: str, parts: int = 0) -> DataFrame:
    """rows with pos, the place in the group from 0 on, and n, the group's rows. group: a column without nulls. A group of any size is spread over the parts; what
    meets in one task is a group's parts."""
    placed = in_parts(rows, [F.col(group).asc(), *order], name, parts)
    of_group = Window.partitionBy(group)
    runs = placed.groupBy(group, "__part").agg(F.count("*").alias("__k"), F.min("__off").alias("__first"))
    before = F.coalesce(F.sum("__k").over(of_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(group, "__part", "__first", before.alias("__before"), F.sum("__k").over(of_group).alias("n"))
    return placed.join(runs, [group, "__part"]).withColumn("pos", F.col("__off") - F.col("__first") + F.col("__before")).drop("__part", "__off", "__first", "__before")
