"""Aggregates and table functions of a user's own, for what built-in functions can't say.

An aggregate has partial states: each task folds its rows into a state for each key, states travel, and those of a key are merged one after the other. A table function goes through the rows
of a key in order with a state. Neither holds a group whole.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # so that no executor needs this package

#: States that a task holds before it gives them on.
MOST_STATES = 50_000


class Fold(Protocol):
    """An aggregate. add() gets a key's rows of one Arrow batch; merge() must not depend on the order of states."""

    kind: str  # the result's type

    def start(self) -> Any: ...
    def add(self, state: Any, rows: pa.RecordBatch) -> Any: ...
    def merge(self, one: Any, other: Any) -> Any: ...
    def done(self, state: Any) -> Any: ...


def fold(rows: DataFrame, by: Sequence[str], values: Sequence[str], f: Fold, name: str) -> DataFrame:
    """by and `name`, the aggregate of the columns `values` for each key; null keys are one key. A key that has any number of rows gives a few states for each task."""
    kind = rows.select(*[F.col(f"`{c}`") for c in by]).schema
    key = F.to_json(F.struct(*[F.col(f"`{c}`") for c in by])).alias("__key") if by else F.lit("{}").alias("__key")
    narrow = rows.select(key, *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(values)])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[str, Any] = {}

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(states), pa.string()), pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], ["__key", "state"])
            states.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("__key").dictionary_encode()
            at = codes.indices.to_numpy()
            order = np.argsort(at, kind="stable")
            cuts = np.r_[0, np.flatnonzero(np.diff(at[order])) + 1, len(order)]
            rest = batch.select(batch.schema.names[1:]).take(pa.array(order))
            for a, b in zip(cuts[:-1], cuts[1:]):
                k = codes.dictionary[int(at[order[a]])].as_py()
                states[k] = f.add(states[k] if k in states else f.start(), rest.slice(a, b - a))
            if len(states) >= MOST_STATES:
                yield given()
        if states:
            yield given()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def told(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([pickle.dumps(f.done(s)) for _, s in done], pa.binary())], ["__key", "state"])

        for batch in batches:
            done = []
            for k, blob in zip(batch.column("__key").to_pylist(), batch.column("state").to_pylist()):
                if k == now:
                    state = f.merge(state, pickle.loads(blob))
                else:
                    if now is not None:
                        done.append((now, state))
                    now, state = k, pickle.loads(blob)
            if done:
                yield told(done)
        if now is not None:
            yield told([(now, state)])

    def values_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole(batches):
            found = pa.array([pickle.loads(x) for x in batch.column("state").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("__key"), found.cast(pa.string()) if f.kind == "string" else found], ["__key", "value"])

    states = narrow.mapInArrow(partial, "__key string, state binary").repartition("__key").sortWithinPartitions("__key")
    out = states.mapInArrow(values_of, f"__key string, value {f.kind}")
    if not by:
        return out.select(F.col("value").alias(name))
    return out.select(F.from_json("__key", kind).alias("__by"), "value").select("__by.*", F.col("value").alias(name))


class CommonPrefix:
    """The longest beginning that all texts have in common; null where there are none but nulls."""

    kind = "string"

    def start(self) -> str | None:
        return None

    def add(self, state: str | None, rows: pa.RecordBatch) -> str | None:
        for text in rows.column(0).drop_null().unique().to_pylist():
            state = self.merge(state, text)
        return state

    def merge(self, one: str | None, other: str | None) -> str | None:
        if one is None or other is None:
            return other if one is None else one
        a, b = min(one, other), max(one, other)
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[:n]

    def done(self, state: str | None) -> str | None:
        return state


class Divisor:
    """The greatest common divisor of whole numbers; null where there are none but nulls."""

    kind = "bigint"

    def start(self) -> int | None:
        return None

    def add(self, state: int | None, rows: pa.RecordBatch) -> int | None:
        found = rows.column(0).drop_null().to_numpy()
        return state if not len(found) else self.merge(state, int(np.gcd.reduce(np.abs(found))))

    def merge(self, one: int | None, other: int | None) -> int | None:
        return one if other is None else other if one is None else int(np.gcd(one, other))

    def done(self, state: int | None) -> int | None:
        return state


@F.arrow_udtf(returnType="id bigint, backlog bigint")
class Backlog:
    """What is left to do after each row: what was left before and came in, less what was done, and never less than nothing. A key's rows come in as many Arrow batches as they take."""

    def __init__(self) -> None:
        self.left = 0

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        amount = rows.column("amount").fill_null(0).to_numpy(zero_copy_only=False)
        if not len(amount):
            return
        if (len(amount) * max(abs(int(amount.min())), abs(int(amount.max()))) + self.left) >> 62:  # sums might not fit
            told = []
            for n in amount.tolist():
                self.left = max(0, self.left + n)
                told.append(self.left)
        else:
            total = self.left + np.cumsum(amount)
            told = total - np.minimum(np.minimum.accumulate(total), 0)
            self.left = int(told[-1])
        yield pa.table({"id": rows.column("id"), "backlog": pa.array(told, pa.int64())})


def backlog(rows: DataFrame, by: str, order: Sequence[str], id: str, amount: Column) -> DataFrame:
    """id and backlog of each row of a table that is taken apart by `by` and gone through in the order of `order`, nulls first. amount: what comes in less what is done, a whole number; null is nothing.
    Null keys are one key. Rows that tie are taken by id."""
    table = rows.select(F.col(by).alias("by"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(id).cast("bigint").alias("id"), amount.cast("bigint").alias("amount"))
    return Backlog(table.asTable().partitionBy("by").orderBy(*[f"o{i}" for i in range(len(order))], "id"))
