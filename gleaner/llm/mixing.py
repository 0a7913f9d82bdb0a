"""Mixing sources to target weights by Sainte-Laguë apportionment.

All tokens are cut into equal blocks. Blocks go to sources by the highest
quotients target / (2 * seats + 1), then each source's blocks go to its shards
in the same way, by shard size. Inside a shard the documents form a stream in a
seeded order; full passes over it come first, and the first blocks of the
stream make up what is left of the shard's quota.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.shared import running

from .ordering import in_parts
from .store import materialize
from .textsql import word_count

SHARD_ROWS = 8192
#: Sources that are apportioned in the driver.
MAX_SOURCES = 100_000


def sainte_lague(weights: Sequence[float], seats: int) -> np.ndarray:
    """Seats by highest quotients w / (2q + 1); ties go to the lower index."""
    w = np.asarray(weights, dtype=np.float64)
    q = np.zeros(len(w), dtype=np.int64)
    if seats <= 0 or not len(w) or w.sum() <= 0:
        return q
    low, high = 0.0, 2.0 * seats / w.sum() + 4.0 / w[w > 0].min()
    for _ in range(200):  # the largest divisor scale that gives no more seats than there are
        mid = (low + high) / 2
        if np.floor(w * mid + 0.5).sum() > seats:
            high = mid
        else:
            low = mid
    q = np.floor(w * (low * (1 - 1e-12)) + 0.5).astype(np.int64)  # a hair below, so that ties are settled here
    heap = [(-x, i) for i, x in enumerate((w / (2 * q + 1)).tolist())]
    heapq.heapify(heap)
    for _ in range(int(seats - q.sum())):
        i = heap[0][1]
        q[i] += 1
        heapq.heapreplace(heap, (-w[i] / (2 * q[i] + 1), i))
    return q


def fill(sizes: Sequence[int], weights: Sequence[float], cap: float) -> np.ndarray:
    """Targets that share sum(sizes) by weight, none above cap times its size;
    what a capped source leaves is shared again among the others by weight."""
    s, w = np.asarray(sizes, dtype=np.float64), np.asarray(weights, dtype=np.float64)
    out, free, left = np.zeros(len(s)), np.ones(len(s), dtype=bool), s.sum()
    while free.any() and left > 0:
        share = left * w[free] / w[free].sum()
        over = share > cap * s[free]
        if not over.any():
            out[free] = share
            break
        ids = np.flatnonzero(free)[over]
        out[ids] = cap * s[ids]
        free[ids] = False
        left = s.sum() - out.sum()
    return out


def _numbered(totals: DataFrame) -> DataFrame:
    """totals with i, the place of __src in the order of code points, null last: by ranges, none of which is everything."""
    n = int(totals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(totals.repartitionByRange(n, F.col("__src").asc_nulls_last()).withColumn("__part", F.spark_partition_id()), "ranges")
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("__part").agg(F.count("*").alias("k")).select("__part", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(F.col("__src").asc_nulls_last())) - 1
    return rows.withColumn("__in", inside).join(before, "__part").withColumn("i", F.col("__in") + F.col("__before")).drop("__part", "__in", "__before")


def _plan_by_search(totals: DataFrame, weights: Sequence[float], cap: int, block: int) -> DataFrame:
    """fill() and sainte_lague() for any number of sources: the level of the targets and the divisor are searched for by sums over all sources."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("i") % len(weights)).cast("int") + 1)
    rows = materialize(_numbered(totals).withColumn("w", w).withColumn("most", F.col("z") * float(cap)), "sources")
    all_of, level = rows.agg(F.sum("z")).first()[0] or 0, 0.0
    while True:  # the level rises until no source is above its cap
        over = F.col("w") * level > F.col("most")
        capped, free = rows.agg(F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).first()
        now = (all_of - capped) / free if free else level
        if now <= level:
            break
        level = now
    rows = rows.withColumn("target", F.least("most", F.col("w") * level))
    total, least = rows.agg(F.sum("target"), F.min(F.when(F.col("target") > 0, F.col("target")))).first()
    seats = int(round((total or 0) / block))
    if not seats or not total:
        return rows.withColumn("seats", F.lit(0).cast("long"))
    given = lambda scale: F.floor(F.col("target") * scale + 0.5)
    low, high = 0.0, 2.0 * seats / total + 4.0 / least
    for _ in range(20):  # sixteen scales at a time
        steps = [low + (high - low) * k / 17 for k in range(1, 17)]
        sums = rows.agg(*[F.sum(given(x)).alias(f"s{k}") for k, x in enumerate(steps)]).first()
        fit = [k for k in range(16) if sums[k] <= seats]
        low, high = (steps[fit[-1]] if fit else low), (steps[fit[-1] + 1] if fit and fit[-1] < 15 else high if fit else steps[0])
    rows = materialize(rows.withColumn("q", given(low * (1 - 1e-12))), "seats")
    rest = seats - rows.agg(F.sum("q")).first()[0]
    extra = rows.orderBy(F.desc(F.col("target") / (2 * F.col("q") + 1)), "i").limit(int(rest)).select("i", F.lit(1).alias("one"))
    return rows.join(extra, "i", "left").withColumn("seats", F.col("q") + F.coalesce("one", F.lit(0)))


def mix(
    df: DataFrame,
    source: Column,
    order: Sequence[Column],
    size: Column,
    weights: Sequence[float] = (5, 2, 1),
    cap: int = 3,
    block: int = 32,
    seed: int = 17,
    shard_rows: int = SHARD_ROWS,
    max_sources: int = MAX_SOURCES,
) -> DataFrame:
    """df with size, source_size, target and taken (how many tokens of the row
    the mix takes, repeats counted), which replace columns of these names.

    source: sources sort by code point, null last, and weigh `weights`,
    repeating. order: identifies a row for the seeded order; rows that tie in
    it and in size are interchangeable, and each counts on its own. size:
    tokens of the row, not null; a row of size 0 takes 0. An empty table gives
    no rows. Up to max_sources sources are apportioned in the driver, which only their totals reach; of more, the targets' level and
    the divisor are searched for by sums. Everything else is per shard of about shard_rows rows.
    """
    spark = df.sparkSession
    clash = ["size", "source_size", "target", "taken"]
    rows = df.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in clash],
        source.alias("__src"), size.alias("__size"), F.xxhash64(F.lit(seed), *order).alias("__at"),
    )
    totals = rows.groupBy("__src").agg(F.sum("__size").alias("z"), F.count("*").alias("n"))
    totals = materialize(totals, "totals")
    columns = [F.col("__src").alias("__src2"), F.col("i").alias("__sid"), F.col("z").alias("source_size"), "target", F.col("seats").alias("__seats"), F.ceil(F.col("n") / shard_rows).cast("long").alias("__shards")]
    if totals.count() <= max_sources:
        found = sorted(totals.collect(), key=lambda r: (r["__src"] is None, r["__src"] or ""))
        targets = fill([r["z"] for r in found], [weights[i % len(weights)] for i in range(len(found))], cap)
        seats = sainte_lague(targets, int(round(targets.sum() / block)))
        plan = spark.createDataFrame(
            [(r["__src"], i, int(r["z"]), int(r["n"]), float(t), int(q)) for i, (r, t, q) in enumerate(zip(found, targets, seats))], "__src string, i long, z long, n long, target double, seats long"
        )
        plan = F.broadcast(plan.select(*columns))
    else:
        plan = materialize(_plan_by_search(totals, weights, cap, block).select(*columns), "plan").hint("merge")
    placed = rows.join(plan, F.col("__src").eqNullSafe(F.col("__src2"))).withColumn("__shard", F.pmod("__at", "__shards"))

    def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__shard", ignore_index=True)
        z = pdf["z"].to_numpy()
        words = np.minimum(sainte_lague(z, int(pdf["seats"].iloc[0])) * block, cap * z)
        full = words // np.maximum(z, 1)
        return pd.DataFrame({"__sid": pdf["__sid"], "__shard": pdf["__shard"], "__full": full, "__rest": words - full * z})

    per_shard = (
        placed.groupBy("__sid", "__shard")
        .agg(F.sum("__size").alias("z"), F.first("__seats").alias("seats"))
        .groupBy("__sid")
        .applyInPandas(quotas, "__sid long, __shard long, __full long, __rest long")
    )
    per_shard = materialize(per_shard, "quotas")
    # Sizes so far in each shard, over parts of bounded size: a row that is repeated very often fills a shard of any length.
    stream = in_parts(placed.join(per_shard, ["__sid", "__shard"]), [F.col(c).asc() for c in ("__sid", "__shard", "__at")] + [c.asc_nulls_first() for c in order] + [F.col("__size").asc()], "stream")
    stream = running(stream, ["__sid", "__shard"], "__size", F.sum, "__before", before=True)
    zero = F.lit(0).cast("long")
    cut = F.greatest(zero, F.least(F.col("__size"), F.col("__rest") - F.coalesce("__before", zero)))
    return (
        stream.withColumn("taken", F.col("__full") * F.col("__size") + cut)
        .withColumn("size", F.col("__size"))
        .select(*[F.col(f"`{c}`") for c in df.columns if c not in clash], *clash)
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    """All documents, measured in words: one row for every row. Null and empty texts have size 0 and are not taken; a null source is one. Rows of one id
    are ordered by their texts, so that null ids are no hot shard."""
    rows = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("n_words"), F.xxhash64("text").alias("of_text")), "sizes")
    return mix(rows, F.col("source"), [F.col("doc_id"), F.col("of_text")], F.col("n_words")).select("doc_id", "size", "source_size", "target", "taken")
