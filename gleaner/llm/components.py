"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v) with m, the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _both(one: tuple[str, str], other: tuple[str, str]) -> Column:
    """Columns u and v of two rows for each row. A union of two selections would have Spark plan what is below twice."""
    return F.inline(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in (one, other)]))


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in links (a, b); root is the least id it reaches.

    Alternates large-star and small-star steps until nothing changes. Each step
    is an aggregate with partial sums and a join; no vertex's links meet in one row.
    """
    pairs = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        large = _with_least(pairs.select(_both(("u", "v"), ("v", "u")))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _with_least(large)  # u > v in all of these
        small = small.select(_both(("v", "m"), ("u", "m"))).filter("u <> v").distinct()
        pairs = materialize(small, "stars")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        mark = now
