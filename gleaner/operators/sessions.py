"""Sessions of events: runs of one key without a pause."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.intervals import islands


def sessions(events: DataFrame, on: Sequence[str], at: Column, gap: int, found: Sequence[Column]) -> DataFrame:
    """One row for each session: on, start (its first event), end (its last event plus gap) and the aggregates `found`.

    at and gap: whole numbers of one unit, such as microseconds. An event that comes more than `gap` after the one before it begins a session. Events with a null time or key are in none;
    events of one time are in one session. A key that has a third of all events, in one session or many, is spread over ranges of time. The same rows as session_window() gives of a stream
    (gleaner.streaming.windows)."""
    return islands(events, on, at, at + gap, found, name="sessions")
