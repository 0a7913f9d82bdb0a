"""As-of join: each row with the latest one before it.

Both sides are put in one order and cut into ranges; within a range the last match is carried on, and each range hands what it ends with to those after it. A key's rows may fill many
ranges, so a key that holds a third of all rows is no large task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.shared import in_order


def _fill(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """rows of in_order() with __filled: the last value that isn't null, of the row or an earlier one of its keys."""
    here = Window.partitionBy("__part", *keys).orderBy("__off").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy(*keys, "__part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("__off"))).alias("__last"))
    handed = last.select(*keys, "__part", F.last("__last", ignorenulls=True).over(before).alias("__handed")).filter("__handed IS NOT NULL")
    inside = rows.withColumn("__in", F.last(value, ignorenulls=True).over(here))
    return inside.join(handed, [*keys, "__part"], "left").withColumn("__filled", F.coalesce("__in", "__handed")).drop("__in", "__handed")


def asof(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_at: Column, right_at: Column, carry: Sequence[str], seq: Column | None = None, most: Column | None = None, strict: bool = False, name: str = "matched"
) -> DataFrame:
    """All rows of left, with `name`: the columns `carry` of the latest right row of the same keys whose time is at or before (strict: before) the left row's, or null.

    Of right rows of one time the one of the greatest seq counts (null least; rows that tie in that too are any of them). most: a match that lies further back than this, in the unit
    of the times, counts as none. A null key or time matches nothing. `name` replaces a column of that name; it is a struct, so that carried columns clash with none. Equal left rows stay rows.
    """
    keys = [f"__k{i}" for i in range(len(on))]
    kept = [c for c in left.columns if c != name]
    side = (0, 1) if strict else (1, 0)  # of left and right rows of one time, what comes first
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row")
    match = F.struct(*[F.col(f"`{c}`") for c in carry])
    lefts = left.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(on, keys)], left_at.alias("__time"), F.lit(side[0]).alias("__side"), F.lit(None).alias("__seq"), row)
    rights = right.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(on, keys)], right_at.alias("__time"), F.lit(side[1]).alias("__side"), (F.lit(None) if seq is None else seq).alias("__seq"),
        F.struct(right_at.alias("at"), match.alias("it")).alias("__match"),
    )
    known = F.col("__time").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    both = lefts.filter(known).unionByName(rights.filter(known), allowMissingColumns=True)
    ordered = in_order(both, [F.col(c).asc_nulls_first() for c in (*keys, "__time", "__side", "__seq")], "asof")
    found = _fill(ordered, keys, "__match").filter("__row IS NOT NULL")
    near = F.lit(True) if most is None else F.col("__time") - F.col("__filled.at") <= most
    found = found.select("__row.*", F.when(near, F.col("__filled.it")).alias(name))
    return found.unionByName(lefts.filter(~known).select("__row.*"), allowMissingColumns=True)
