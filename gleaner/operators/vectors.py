"""Nearest neighbours among vectors: an inverted file, searched in blocks.

Centres are fitted on a bounded sample; every row is put in the cell of its nearest centre. A query looks into the cells of its nearest centres, as many as a stated recall takes. A cell
is cut into blocks of bounded size, and so are the queries that look into it, so no task holds a cell whole, however many vectors are in it or alike. Distances are Euclidean,
squared; of equal ones the smaller id comes first.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.shared import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # so that no executor needs this package

#: Vectors that centres are fitted on, centres at most, vectors and queries of a block, queries that the number of probes is chosen by.
SAMPLE, MOST_CELLS, BLOCK, QUERIES, TRIED = 20_000, 4096, 16_384, 4096, 256
FOUND = "query_id long, id long, distance double"


@dataclass(frozen=True)
class Index:
    """rows: id, vector, cell and block; centres: one a cell; blocks: of each cell; dim: of all vectors."""

    rows: DataFrame
    centres: np.ndarray
    blocks: list[int]
    dim: int


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has that many finite numbers and nothing else."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite, F.lit(False))


def _rows_of(df: DataFrame, id: str, vector: str, dim: int) -> DataFrame:
    return df.filter(F.col(id).isNotNull() & usable(F.col(vector), dim)).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector"))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def squares(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of all q to all x, but for rounding."""
    return (q * q).sum(1)[:, None] - 2 * (q @ x.T) + (x * x).sum(1)[None, :]


def fit(x: np.ndarray, cells: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """Centres by k-means; of fewer different vectors, the vectors themselves."""
    x = np.unique(x, axis=0)
    if len(x) <= cells:
        return x
    centres = x[np.random.default_rng(seed).choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        at = np.concatenate([squares(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(at, minlength=cells)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _near_cells(df: DataFrame, centres: np.ndarray, count: int, columns: str) -> DataFrame:
    """Rows of df (id, vector), each for its `count` nearest cells, with cell and nth (0 for the nearest)."""
    dim = centres.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                far = squares(matrix(batch.column("vector"), dim), centres)
                order = far.argmin(1)[:, None] if count == 1 else far.argsort(1, kind="stable")[:, :count]
                again = batch.take(pa.array(np.repeat(np.arange(len(order)), order.shape[1])))
                nth = np.tile(np.arange(order.shape[1]), len(order))
                yield pa.RecordBatch.from_arrays([again.column("id"), again.column("vector"), pa.array(order.ravel().astype(np.int32)), pa.array(nth.astype(np.int32))], ["id", "vector", "cell", "nth"])

    return df.select("id", "vector").mapInArrow(place, columns)


_PLACED = "id long, vector array<float>, cell int, nth int"


def build(df: DataFrame, id: str, vector: str, cells: int | None = None, sample: int = SAMPLE, dim: int | None = None) -> Index:
    """An index of all rows of df. Rows with a null id, a null or unfinite number or another length than `dim` (by default the commonest one) are in no cell; equal rows are all in it.

    cells: by default as many as half the square root of the rows, 4,096 at most. sample: of so many rows, or a little more, chosen by a hash of their ids, the driver has the vectors.
    """
    if dim is None:
        common = df.groupBy(F.size(F.col(vector)).alias("n")).count().filter("n > 0").orderBy(F.desc("count"), "n").first()
        dim = common["n"] if common else 1
    rows = _rows_of(df, id, vector, dim)
    n = rows.count()
    cells = cells or int(min(MOST_CELLS, max(1, n**0.5 // 2)))
    some = rows if n <= sample else rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * sample / n) + 1)
    got = some.select("vector").toArrow().column("vector")
    centres = fit(matrix(got, dim), cells) if len(got) else np.zeros((1, dim))
    placed = written(_near_cells(rows, centres, 1, _PLACED).drop("nth"), "cells")
    blocks = [1] * len(centres)
    for r in placed.groupBy("cell").count().collect():  # a row for each cell
        blocks[r["cell"]] = -(-r["count"] // BLOCK)
    cut = F.pmod(F.xxhash64(F.lit(1), "id", F.monotonically_increasing_id()), _of_cell(blocks)).cast("int")
    return Index(placed.withColumn("block", cut), centres, blocks, dim)


def _of_cell(counts: list[int]) -> Column:
    """counts[cell]; only cells that aren't 1 are written out."""
    more = {c: n for c, n in enumerate(counts) if n > 1}
    if not more:
        return F.lit(1)
    table = F.create_map(*[F.lit(v) for c, n in more.items() for v in (c, n)])
    return F.coalesce(F.try_element_at(table, F.col("cell")), F.lit(1))


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the query, ids, distances) of the k nearest x of each q, but for rows that have the query's own id."""
    size = (x * x).sum(1)
    slack = 1e-9 * (size.max(initial=0) + 1)
    for i in range(0, len(q), 256):
        part = squares(q[i : i + 256], x)
        part[own[i : i + 256, None] == ids[None, :]] = np.inf
        bound = np.partition(part, k - 1, axis=1)[:, k - 1] if part.shape[1] > k else np.full(len(part), np.inf)
        for j, row in enumerate(part):
            at = np.flatnonzero((row <= bound[j] + slack + 1e-9 * (q[i + j] ** 2).sum()) & np.isfinite(row))
            exact = ((x[at] - q[i + j]) ** 2).sum(1)
            best = np.lexsort((ids[at], exact))[:k]
            yield i + j, ids[at][best], exact[best]


def _meet(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query in each block that it looks into, and of these the k nearest."""
    counts, dim = [1] * len(index.centres), index.dim
    for r in asked.groupBy("cell").count().collect():
        counts[r["cell"]] = -(-r["count"] // QUERIES)
    deal = F.pmod(F.xxhash64(F.lit(2), "id", F.monotonically_increasing_id()), _of_cell(counts)).cast("int")
    left = asked.select("cell", F.explode(F.sequence(F.lit(0), _of_cell(index.blocks) - 1)).alias("block"), deal.alias("part"), "id", "vector")
    right = index.rows.select("cell", "block", F.explode(F.sequence(F.lit(0), _of_cell(counts) - 1)).alias("part"), "id", "vector")
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        own, ids = a.column("id").to_numpy(), b.column("id").to_numpy()
        got = [(np.full(len(x), own[i]), x, d) for i, x, d in nearest(matrix(a.column("vector"), dim), matrix(b.column("vector"), dim), ids, own, k)]
        return pa.table([np.concatenate(c) for c in zip(*got)], schema=schema)

    by = ["cell", "block", "part"]
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(pair, FOUND)
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return met.withColumn("rank", first).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, id: str, vector: str, k: int = 10, probes: int = 1) -> DataFrame:
    """query_id, rank (1 to k), id and distance of the nearest rows that the query's `probes` nearest cells hold, a row of its own id left out.

    Queries with a null id or an unusable vector have no rows; each id should be asked once, for answers are put together by it. Where fewer rows are found there are fewer ranks.
    """
    asked = written(_near_cells(_rows_of(queries, id, vector, index.dim), index.centres, min(probes, len(index.centres)), _PLACED), "asked")
    return _meet(index, asked, k).select("query_id", "rank", "id", "distance")


def exact(df: DataFrame, queries: DataFrame, id: str, vector: str, k: int = 10, dim: int | None = None) -> DataFrame:
    """search() over all rows, in blocks: a stated query set against everything."""
    return search(build(df, id, vector, cells=1, dim=dim), queries, id, vector, k)


def probes_for(index: Index, queries: DataFrame, id: str, vector: str, k: int = 10, recall: float = 0.95, tried: int = TRIED) -> int:
    """The fewest probes that find a share `recall` of the true neighbours of up to about `tried` of the queries.

    One pass over all rows finds these queries' neighbours; each counts for the place that its cell has among the cells nearest to the query."""
    rows = _rows_of(queries, id, vector, index.dim)
    n = rows.count()
    some = rows if n <= tried else rows.filter(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1_000_000)) < int(1_000_000 * tried / n) + 1)
    cells = len(index.centres)
    ordered = written(_near_cells(some, index.centres, cells, _PLACED), "tried")
    one = Index(index.rows.select("id", "vector", F.lit(0).alias("cell"), F.pmod(F.xxhash64("id", "block", "cell"), F.lit(sum(index.blocks))).cast("int").alias("block")), index.centres[:1], [sum(index.blocks)], index.dim)
    true = _meet(one, ordered.filter("nth = 0").withColumn("cell", F.lit(0)), k).select("query_id", "id")
    places = index.rows.select("id", "cell").join(true, "id").join(ordered.select(F.col("id").alias("query_id"), "cell", "nth"), ["query_id", "cell"])
    found = [0] * cells
    for r in places.groupBy("nth").count().collect():  # a row for each place
        found[r["nth"]] = r["count"]
    wanted, so_far = recall * sum(found), 0
    for p, m in enumerate(found):
        so_far += m
        if so_far >= wanted:
            return p + 1
    return cells
