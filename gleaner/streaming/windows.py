"""Event-time windows over streams: sessions, and a join of two streams, both with bounded state.

Their batch forms, which give the same rows, are gleaner.operators.sessions and gleaner.operators.intervals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_sessions(events: DataFrame, on: Sequence[str], at: str, gap: str, late: str, found: Mapping[str, Column]) -> DataFrame:
    """on, start, end and the aggregates `found` (by name) of each session of a stream of events, once it is closed.

    late: how far an event may lie behind the latest one that earlier batches have seen. An event beyond that is dropped, even one that would lengthen a session that is still open; a session is given
    out, and its state goes, when that bound has passed its end. So state holds the sessions of the last `late` and gap, whatever the stream's length. Sessions still open are in no output.
    """
    rows = events.dropna(subset=[*on, at]).withWatermark(at, late)
    window = F.session_window(at, gap)
    made = rows.groupBy(*on, window.alias("window")).agg(*[c.alias(name) for name, c in found.items()])
    return made.select(*on, F.col("window.start").alias("start"), F.col("window.end").alias("end"), *found)


def stream_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], left_at: str, right_at: str, most: str, late: str, how: str = "inner") -> DataFrame:
    """Pairs of rows of two streams, as structs a and b: equal `on`, and the right row at most `most` after the left one and not before it.

    Both sides are late by `late` at most; rows beyond that are dropped. A right row waits for left ones no longer than `late`, a left row for right ones no longer than `most` and `late`, so state is bounded by
    time on both sides. how: inner, or leftOuter, which gives a left row without a pair once none can come. Null keys pair with nothing.
    """
    a = left.withWatermark(left_at, late).select(F.struct(*left.columns).alias("a"), F.col(left_at).alias("__a_at"), *[F.col(c).alias(f"__a_{i}") for i, c in enumerate(on)])
    b = right.withWatermark(right_at, late).select(F.struct(*right.columns).alias("b"), F.col(right_at).alias("__b_at"), *[F.col(c).alias(f"__b_{i}") for i, c in enumerate(on)])
    near = (F.col("__b_at") >= F.col("__a_at")) & (F.col("__b_at") <= F.col("__a_at") + F.expr(f"INTERVAL {most}"))
    for i in range(len(on)):
        near = near & (F.col(f"__a_{i}") == F.col(f"__b_{i}"))
    return a.join(b, near, how).select("a", "b")


def run_once(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """All that a stream has now, appended to a table; the next call goes on from there."""
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
