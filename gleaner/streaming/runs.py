"""Collecting runs as keyed state over a stream of page events.

A run's state outlives any one process: it is in the stream's checkpoint. The batch form is
gleaner.operators.run; this gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.operators.run import MAX_AGE_MS

OUT = "run_id string, page_no int, added int, collected int, status string"
STATE = "total int, remaining int, collected int, started_at long"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Events in order of seq: start (total), page (added, has_next), stop. at_ms: the event's time."""
    rows = []
    total, remaining, collected, started = state.get if state.exists else (0, 0, 0, 0)

    def tell(status: str, page: int = 0, added: int = 0) -> None:
        rows.append((key[0], page, added, collected, status))

    if state.hasTimedOut:
        tell("expired")
        state.remove()
        yield pd.DataFrame(rows, columns=["run_id", "page_no", "added", "collected", "status"])
        return
    for e in pd.concat(list(batches)).sort_values("seq").itertuples():
        if e.kind == "start":
            if remaining > 0 and e.at_ms - started <= MAX_AGE_MS:
                tell("refused")
                continue
            total, remaining, collected, started = int(e.total), int(e.total), 0, int(e.at_ms)
            tell("started")
        elif remaining <= 0:
            continue
        elif e.kind == "stop":
            remaining = 0
            tell("stopped")
        elif e.at_ms - started > MAX_AGE_MS:
            remaining = 0
            tell("expired")
        else:
            page = total - remaining + 1
            remaining -= 1
            collected += int(e.added)
            if remaining > 0 and not e.has_next:
                remaining = 0
            tell("done" if remaining == 0 else "page", page, int(e.added))
    if remaining > 0:
        state.update((total, remaining, collected, started))
        state.setTimeoutTimestamp(max(started + MAX_AGE_MS, state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(rows, columns=["run_id", "page_no", "added", "collected", "status"])


def follow(events: DataFrame) -> DataFrame:
    """events: run_id, seq, kind, total, added, has_next, at_ms. A run that is left alone is told as expired, and its state goes, when the events of
    all runs are a run's greatest age (and the watermark's delay, as long again) beyond its start. Later events are dropped."""
    timed = events.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", f"{MAX_AGE_MS} milliseconds")
    return timed.groupBy("run_id").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
