"""Distinct counts and quantiles from sketches that are kept for each day and merged, so that no day is read twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Binary digits of the registers of a distinct count, size of a quantile sketch; and the errors stated for them: six standard errors of the count (three fail for one group in some hundreds), and the rank of a quantile.
DIGITS, SIZE = 14, 400
COUNT_ERROR, RANK_ERROR = 6 * 1.04 / 2 ** (DIGITS / 2), 0.02


def sketched(rows: DataFrame, by: Sequence[str | Column], distinct: Column, value: Column) -> DataFrame:
    """by, n_rows (rows with a value or a thing to count), things (a sketch of the distinct ones) and spread (one of the values).

    Sketches are made on the map side and merged, some 20 KB a group at most however many rows it has, and a few bytes a row in small groups. Nulls and values that are no number are in no sketch; a group of nulls alone has empty sketches.
    """
    number = F.when(~F.isnan(value.cast("double")), value.cast("double"))
    some = F.count_if(distinct.isNotNull() | number.isNotNull())
    return rows.groupBy(*by).agg(some.alias("n_rows"), F.hll_sketch_agg(distinct, F.lit(DIGITS)).alias("things"), F.kll_sketch_agg_double(number, F.lit(SIZE)).alias("spread"))


def merged(sketches: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """The sketches of coarser groups from those of finer ones, or of days seen again: rows counted in two sketches are counted once in things and twice in n_rows and spread."""
    return sketches.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.hll_union_agg("things").alias("things"), F.kll_merge_agg_double("spread").alias("spread"))


def read(sketches: DataFrame, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Sketches with n_things (within COUNT_ERROR of the true number, but for one group in some hundred millions) and quantiles (values whose ranks are within RANK_ERROR of `shares`; null where there are
    no values) in their place."""
    held = F.kll_sketch_get_n_double("spread") > 0
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    return sketches.withColumns({"n_things": F.hll_sketch_estimate("things"), "quantiles": F.when(held, F.kll_sketch_get_quantile_double("spread", wanted))}).drop("things", "spread")
