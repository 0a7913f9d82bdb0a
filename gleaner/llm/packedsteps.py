"""Steps over packed rows: blobs of unsigned 64-bit numbers, dealt into buckets by a key.

A row in Spark is a blob, so that many millions of small rows cost neither a row's overhead nor a sort each. A step
reads one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .units import U, give_back, mix

SQL = "kind int, bucket long, x long, y long, z long, blob binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("z", pa.int64()), ("blob", pa.binary())])
#: Rows of kind PLAIN are not packed: x, y and z are numbers of their own.
PLAIN = 0


def batch(kind: int, n: int, **columns) -> pa.RecordBatch:
    made = {"kind": pa.array(np.full(n, kind, dtype=np.int32))} | {k: v if isinstance(v, pa.Array) else pa.array(v, _SCHEMA.field(k).type) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(n, f.type)) for f in _SCHEMA], schema=_SCHEMA)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key.view(U) + U(0x2545F4914F6CDD1D)) % U(buckets)).astype(np.int64)


def dealt(kind: int, rows: np.ndarray, key: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Packed rows (n x c) in blobs by the bucket of their key."""
    k = bucket_of(key, buckets)
    order = np.argsort(k, kind="stable")
    rows, k = np.ascontiguousarray(rows[order], dtype=U), k[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, dtype=np.int64)
    ends = np.r_[at[1:], len(k)]
    return batch(kind, len(at), bucket=k[at], blob=[rows[a:b].tobytes() for a, b in zip(at, ends)])


class Bucket(dict):
    """The rows of one bucket by kind: lists of (x, y, z, blob)."""

    def rows(self, kind: int, columns: int) -> np.ndarray:
        return np.frombuffer(b"".join(r[3] for r in self.get(kind, ())), dtype=U).reshape(-1, columns)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    now, held = None, Bucket()
    for b in batches:
        for kind, k, x, y, z, blob in zip(*[b.column(c).to_pylist() for c in _SCHEMA.names]):
            if k != now and held:
                yield held
                held = Bucket()
            now = k
            held.setdefault(kind, []).append((x, y, z, blob))
    if held:
        yield held


def step(df: DataFrame, work: Callable[[Bucket], Iterator[pa.RecordBatch]], spread: bool = False) -> DataFrame:
    """What work makes of each bucket. spread: its time doesn't follow its bytes, so partitions are not put together by size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bucket(batches):
            yield from work(b)
        give_back()

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    there = df.repartition(n, "bucket") if spread else df.repartition("bucket")
    return there.sortWithinPartitions("bucket").mapInArrow(run, SQL)


def pack(df: DataFrame, kind: int, columns: list[str], buckets: int) -> DataFrame:
    """Rows of numbers as packed rows, by their first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(U) for c in columns], axis=1)
                yield dealt(kind, rows, rows[:, 0], buckets)

    return df.select(*columns).mapInArrow(run, SQL)


def groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return at, np.diff(np.r_[at, len(sorted_keys)])
