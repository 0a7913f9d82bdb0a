"""Paged collecting runs: numbering, expiry, stopping and running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: a run expires so long after its start.
MAX_AGE_MS = 20 * 60 * 1000
LIVE_MS = 3000


def page_number(total: Column, remaining: Column) -> Column:
    return total - remaining + 1


def resumable(now_ms: Column, started_ms: Column, remaining: Column, supported: Column | None = None) -> Column:
    """Whether a stored run goes on: something remains, the site is known, and its start is at most 20 minutes ago."""
    fresh = F.coalesce((F.nullif(started_ms, F.lit(0)).isNotNull()) & (now_ms - started_ms <= MAX_AGE_MS), F.lit(False))
    return fresh & F.coalesce(remaining > 0, F.lit(False)) & (F.lit(True) if supported is None else F.coalesce(supported, F.lit(False)))


def advance(state: DataFrame) -> DataFrame:
    """A run's state after a page: added (new postings) and has_next come with it. done: whether it ends there."""
    left = F.col("remaining") - 1
    return state.withColumns(
        {"page_no": page_number(F.col("total"), F.col("remaining")), "remaining": left, "collected": F.coalesce("collected", F.lit(0)) + F.col("added"), "done": (left <= 0) | ~F.col("has_next")}
    )


def before_stop(rows: DataFrame, stop: Column, order: str, by: Sequence[str]) -> DataFrame:
    """Rows before the first stop of their run; all where there is none."""
    at = rows.groupBy(*by).agg(F.min(F.when(stop, F.col(order))).alias("__stop"))
    return rows.join(at, list(by)).filter(F.col("__stop").isNull() | (F.col(order) < F.col("__stop"))).drop("__stop")


def running_total(rows: DataFrame, value: str, order: str, by: Sequence[str], name: str = "running", chunk: Column | None = None) -> DataFrame:
    """Sum of value so far, within by. chunk: a coarser order (a month for days); then no task holds more than one
    chunk's rows, or one row for each chunk."""
    if chunk is None:
        return rows.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    cut = rows.withColumn("__chunk", chunk)
    inside = Window.partitionBy(*by, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*by, "__chunk").agg(F.sum(value).alias("__sum")).select(*by, "__chunk", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    return cut.withColumn("__in", F.sum(value).over(inside)).join(sums, [*by, "__chunk"]).withColumn(name, F.col("__before") + F.col("__in")).drop("__chunk", "__in", "__before")


def shown_status(now_ms: Column, last_live_ms: Column, stored: Column, live: Column) -> Column:
    """A live message is shown for three seconds after it came; then the stored status."""
    return F.when(now_ms - F.coalesce(last_live_ms, F.lit(0)) > LIVE_MS, stored).otherwise(live)
