"""Aggregates at many levels at once: cubes, rollups, grouping sets and pivots from one pass over the rows.

Rows are summed up at the finest level first; the levels are made of these sums. So what is multiplied by the number of levels is groups, not rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FINE = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
_COARSE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def cube(dims: Sequence[str]) -> list[tuple[str, ...]]:
    return [c for n in range(len(dims), -1, -1) for c in combinations(dims, n)]


def rollup(dims: Sequence[str]) -> list[tuple[str, ...]]:
    return [tuple(dims[:n]) for n in range(len(dims), -1, -1)]


def levels(rows: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]], measures: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """A row for each group of each set: dims (null where the set leaves one out), grouping_id, and the measures.

    measures: name to (sum, count, min, max or avg, value). grouping_id has a bit for each dim, the first the highest, that is set where the set leaves it out, so that the group of null values is told
    from all values together. A set that is given twice gives its rows twice. No rows have no groups, not even that of the empty set.
    """
    parts: dict[str, tuple[str, Column]] = {}
    for name, (kind, value) in measures.items():
        parts |= {f"{name}__sum": ("sum", value.cast("double")), f"{name}__count": ("count", value)} if kind == "avg" else {name: (kind, value)}
    fine = rows.groupBy(*dims).agg(*[_FINE[kind](value).alias(name) for name, (kind, value) in parts.items()])
    coarse = [_COARSE[kind](name).alias(name) for name, (kind, _) in parts.items()]
    wide = fine.groupingSets([[F.col(d) for d in s] for s in sets], *[F.col(d) for d in dims]).agg(F.grouping_id(*dims).cast("long").alias("grouping_id"), *coarse)

    def shown(name: str, kind: str) -> Column:
        if kind == "avg":
            return (F.col(f"{name}__sum") / F.nullif(F.col(f"{name}__count"), F.lit(0))).alias(name)
        return (F.coalesce(name, F.lit(0)).cast("long") if kind == "count" else F.col(name)).alias(name)

    return wide.select(*dims, "grouping_id", *[shown(name, kind) for name, (kind, _) in measures.items()])


def pivoted(rows: DataFrame, by: Sequence[str], column: str, values: Sequence, measure: str, value: Column) -> DataFrame:
    """by, and a column for each of `values` with the measure (sum, count, min or max) of the rows where `column` is that; null where there are none, null values under `null`. Values that aren't named
    are in no column. The list is given, so that the rows are read once and the columns are known beforehand."""
    fine = rows.groupBy(*by, column).agg(_FINE[measure](value).alias("__m"))
    cell = lambda v: F.col(column).isNull() if v is None else F.col(column) == v
    return fine.groupBy(*by).agg(*[_COARSE[measure](F.when(cell(v), F.col("__m"))).alias("null" if v is None else str(v)) for v in values])
