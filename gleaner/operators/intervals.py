"""Interval joins by bins, with each pair made in one bin; spans that overlap made one.

An interval belongs to a level, the least width of a bin that is no shorter than it, so that it touches two bins of its level at most. Two intervals meet at the higher of their
levels, in the bin where the later of them starts. Widths go up in steps of eight times, so there are few levels, and a very long interval isn't cut into many bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.asof import asof
from gleaner.operators.shared import in_order, running

#: Binary digits from one level to the next.
STEP = 3


def _levelled(df: DataFrame, start: Column, end: Column, on: Sequence[Column], tag: str) -> DataFrame:
    """Intervals that hold something: row, start, end and level; empty ones and those with a null end or key go."""
    keys = [k.alias(f"__k{i}") for i, k in enumerate(on)]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(tag), start.cast("long").alias(f"__s_{tag}"), end.cast("long").alias(f"__e_{tag}"), *keys)
    rows = rows.filter(f"__e_{tag} > __s_{tag}").dropna(subset=[f"__k{i}" for i in range(len(on))]) if on else rows.filter(f"__e_{tag} > __s_{tag}")
    digits = F.when(F.expr(f"__e_{tag} - __s_{tag} > 1"), F.length(F.bin(F.expr(f"__e_{tag} - __s_{tag} - 1")))).otherwise(0)
    return rows.withColumn(f"__l_{tag}", (F.ceil(digits / STEP) * STEP).cast("int"))


def _levels(df: DataFrame, tag: str) -> list[int]:
    """The levels that occur, of which there are 22 at most."""
    return sorted(df.agg(F.collect_set(f"__l_{tag}").alias("x")).first()["x"])


def _binned(df: DataFrame, tag: str, others: Sequence[int], spread: int, deal: bool) -> DataFrame:
    """Each interval in its bins at its own level and at the higher ones of the other side."""
    own, level = F.col(f"__l_{tag}"), F.array(*[F.lit(x) for x in others]).cast("array<int>")
    levels = F.array_distinct(F.concat(F.array(own), F.filter(level, lambda x: x > own)))
    df = df.withColumn("__level", F.explode(levels))
    df = df.withColumn("__bin", F.explode(F.expr(f"sequence(shiftright(__s_{tag}, __level), shiftright(__e_{tag} - 1, __level))")))
    if spread > 1:
        df = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(spread)).cast("int") if deal else F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return df


def _met(a: DataFrame, b: DataFrame, keys: int, spread: int, how: str) -> DataFrame:
    b = b.withColumnsRenamed({c: f"{c}_b" for c in b.columns if c.startswith("__k") or c in ("__level", "__bin", "__salt")})
    same = [*[f"__k{i}" for i in range(keys)], "__level", "__bin", *["__salt"] * (spread > 1)]
    on = F.greatest("__l_a", "__l_b") == F.col("__level")
    for c in same:
        on = on & (F.col(c) == F.col(f"{c}_b"))
    on = on & (F.expr("shiftright(greatest(__s_a, __s_b), __level)") == F.col("__bin")) & (F.col("__s_a") < F.col("__e_b")) & (F.col("__s_b") < F.col("__e_a"))
    return a.join(b, on, how)


def overlapping(
    left: DataFrame, right: DataFrame, left_span: tuple[Column, Column], right_span: tuple[Column, Column], left_on: Sequence[Column] = (), right_on: Sequence[Column] = (), spread: int = 1
) -> DataFrame:
    """All pairs of a left and a right row whose half-open spans [start, end) have something in common, as structs a and b.

    Spans are whole numbers, such as microseconds; a point t is [t, t + 1). left_on and right_on: values that must be equal. Empty spans (an end at or before the start) and null ends or values are in no
    pair; equal rows pair each for itself. spread: left rows are dealt to so many tasks for each bin, to which the right ones are copied; for bins that hold very much of the left side.
    """
    a, b = _levelled(left, *left_span, left_on, "a"), _levelled(right, *right_span, right_on, "b")
    low, high = _levels(a, "a"), _levels(b, "b")
    return _met(_binned(a, "a", high, spread, True), _binned(b, "b", low, spread, False), len(left_on), spread, "inner").select("a", "b")


def islands(spans: DataFrame, on: Sequence[str], start: Column, end: Column, found: Sequence[Column] = (), touching: bool = True, name: str = "islands") -> DataFrame:
    """Spans of equal `on` that overlap (touching: or meet end to start) made one: on, start, end and what the aggregates `found` give of the spans in it.

    Empty spans and those with a null end or value are in none. Rows are put in order and cut into ranges, with the greatest end so far and the number of the island handed from range to range: a value of
    `on` that has a third of all spans, or an island that has, is no large task."""
    rows = spans.withColumns({"__s": start, "__e": end}).filter("__e > __s")
    rows = rows.dropna(subset=list(on)) if on else rows.withColumn("__one", F.lit(0))
    keys = list(on) or ["__one"]
    rows = in_order(rows, [F.col(k).asc() for k in (*keys, "__s", "__e")], name)
    rows = running(rows, keys, "__e", F.max, "__until", before=True)
    apart = F.col("__s") > F.col("__until") if touching else F.col("__s") >= F.col("__until")
    rows = running(rows.withColumn("__new", F.coalesce(apart, F.lit(True)).cast("long")), keys, "__new", F.sum, "__island")
    return rows.groupBy(*keys, "__island").agg(F.min("__s").alias("start"), F.max("__e").alias("end"), *found).drop("__island", "__one")


def inside_any(points: DataFrame, at: Column, spans: DataFrame, start: Column, end: Column, on: Sequence[str] = (), name: str = "island") -> DataFrame:
    """All points, with `name`: the start and end of the island of spans that a point lies in, or null. Each point is looked up once, however many spans hold it: the islands don't overlap, so
    it can only be the last one that starts at or before it."""
    made = islands(spans, on, start, end)
    keys = list(on) or ["__one"]
    if not on:
        points, made = points.withColumn("__one", F.lit(0)), made.withColumn("__one", F.lit(0))
    out = asof(points.withColumn("__at", at), made, keys, at, F.col("start"), ["start", "end"], name=name)
    held = F.col("__at") < F.col(f"{name}.end")
    return out.withColumn(name, F.when(held, F.col(name))).drop("__at", "__one")
