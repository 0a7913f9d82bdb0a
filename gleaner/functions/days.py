"""Calendar days of a place: which day an instant is in, when a day begins and ends, and days without a gap.

Instants are timestamps without a zone, on the clock of UTC. Days that a clock change makes shorter or longer have 23 or 25 hours; where a change leaves out midnight, the day begins
at the first instant after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def local_day(instant: Column, zone: str) -> Column:
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), instant.cast("timestamp_ntz")))


def begins(day: Column, zone: str) -> Column:
    """The instant at which a day begins."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), day.cast("timestamp_ntz"))


def hours(day: Column, zone: str) -> Column:
    """How many hours a day has."""
    return F.timestamp_diff("MINUTE", begins(day, zone), begins(F.date_add(day, 1), zone)) / 60


def spine(days: DataFrame, day: str, by: list[str]) -> DataFrame:
    """by and `day` for every day from a group's first to its last; null days are none."""
    ends = days.groupBy(*by).agg(F.min(day).alias("__a"), F.max(day).alias("__b")).filter("__a IS NOT NULL")
    return ends.select(*by, F.explode(F.sequence("__a", "__b")).alias(day))


def per_day(rows: DataFrame, instant: Column, zone: str, by: list[str]) -> DataFrame:
    """by, day, begins, hours and n, the rows of each local day: days without rows, between a group's first and last, have 0. Rows with a null instant are in no day; null groups are groups."""
    counted = rows.select(*by, local_day(instant, zone).alias("day")).filter("day IS NOT NULL").groupBy(*by, "day").agg(F.count("*").alias("__n"))
    every = spine(counted, "day", by)
    same = every["day"] == counted["day"]
    for c in by:
        same = same & every[c].eqNullSafe(counted[c])
    met = every.join(counted, same, "left").select(*[every[c] for c in by], every["day"], F.coalesce("__n", F.lit(0)).alias("n"))
    return met.select(*by, "day", begins(F.col("day"), zone).alias("begins"), hours(F.col("day"), zone).alias("hours"), F.col("n").cast("long").alias("n"))
