"""Byte-balanced shards by Karmarkar-Karp differencing.

Groups that may not be divided (rows with one key) are dealt into pools of
bounded size. In a pool, the partial partitions with the largest spread are
combined again and again, oppositely ordered, until one is left. What is left
of the pools is itself a set of partial partitions, which the next level
combines in the same way, so that no task ever holds more than one pool.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered
from .store import materialize

POOL = 16_384


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine n partial k-way partitions (n x k sums) into one.

    Returns its k sums, and for every input row the final slot of each of its
    k entries. Ties go to the earlier row.
    """
    n, k = parts.shape
    place = np.zeros((n, k), dtype=np.int32)
    if n == 0:
        return np.zeros(k, dtype=np.int64), place
    sums: list[list[int]] = []
    origin: list[list[int]] = []  # of a leaf: which entry is at each ordered position
    for row in parts.tolist():
        o = sorted(range(k), key=lambda j: -row[j])
        origin.append(o)
        sums.append([row[j] for j in o])
    heap = [(s[-1] - s[0], i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    made: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        a = heapq.heappop(heap)[1]
        b = heapq.heappop(heap)[1]
        both = [x + y for x, y in zip(sums[a], reversed(sums[b]))]
        o = sorted(range(k), key=lambda j: -both[j])
        s = [both[j] for j in o]
        sums[a] = sums[b] = []
        made.append((a, b, o))
        sums.append(s)
        heapq.heappush(heap, (s[-1] - s[0], len(sums) - 1))
    top = heap[0][1]
    slots: dict[int, list[int]] = {top: list(range(k))}
    for node in range(len(sums) - 1, n - 1, -1):
        a, b, o = made[node - n]
        mine = slots.pop(node)
        of_a, of_b = [0] * k, [0] * k
        for j, at in enumerate(o):
            of_a[at] = mine[j]
            of_b[k - 1 - at] = mine[j]
        slots[a], slots[b] = of_a, of_b
    for i in range(n):
        for j, at in enumerate(origin[i]):
            place[i, at] = slots[i][j]
    return np.array(sums[top], dtype=np.int64), place


def _assign(groups: DataFrame, n_groups: int, k: int, pool: int) -> DataFrame:
    """groups (__key binary, __bytes long) with __shard."""
    spark = groups.sparkSession
    names = [f"s{j}" for j in range(k)]

    def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__bytes", "__key"], ignore_index=True)
        parts = np.zeros((len(pdf), k), dtype=np.int64)
        parts[:, 0] = pdf["__bytes"]
        total, place = difference(parts)
        out = pd.DataFrame({"pool": pdf["pool"], "__key": pdf["__key"], "local": place[:, 0]})
        top = pd.DataFrame([[pdf["pool"].iloc[0], None, -1, *total.tolist()]], columns=["pool", "__key", "local", *names])
        return pd.concat([out.assign(**{c: 0 for c in names}), top], ignore_index=True)

    pools = max(1, -(-n_groups // pool))
    dealt = groups.withColumn("pool", F.pmod(F.xxhash64("__key"), F.lit(pools)))
    sums_of = ", ".join(f"{c} long" for c in names)
    level = materialize(
        dealt.groupBy("pool").applyInPandas(leaves, f"pool long, __key binary, local int, {sums_of}"), "pools"
    )
    here = level.filter("local >= 0").select("__key", "pool", "local")
    tops = level.filter("local < 0").select("pool", *names)

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pool", ignore_index=True)
        total, place = difference(pdf[names].to_numpy(dtype=np.int64))
        out = pd.DataFrame(place.astype(np.int64), columns=names)
        out.insert(0, "next", pdf["next"])
        out.insert(0, "pool", pdf["pool"])
        top = pd.DataFrame([[-1, pdf["next"].iloc[0], *total.tolist()]], columns=["pool", "next", *names])
        return pd.concat([out, top], ignore_index=True)

    while True:
        fewer = max(1, -(-pools // pool))
        step = materialize(
            tops.withColumn("next", F.pmod(F.xxhash64("pool"), F.lit(fewer)))
            .groupBy("next").applyInPandas(combine, f"pool long, next long, {sums_of}"),
            "combined",
        )
        moves = step.filter("pool >= 0").select("pool", "next", F.array(*names).alias("to"))
        here = here.join(moves, "pool").select("__key", F.col("next").alias("pool"), F.element_at("to", F.col("local") + 1).cast("int").alias("local"))
        if fewer == 1:
            return here.select("__key", F.col("local").alias("__shard"))
        pools, tops = fewer, step.filter("pool < 0").select(F.col("next").alias("pool"), *names)


def shard(
    df: DataFrame,
    key: Column,
    size: Column,
    order: Sequence[Column],
    n_shards: int = 8,
    pool: int = POOL,
    chunk_rows: int = 50_000,
) -> DataFrame:
    """df with shard and slot, which replace columns of these names.

    Rows of equal key (null is a key of its own) stay in one shard; shards are
    near equal in the sum of size. slot counts from 0 in each shard, without
    gaps, in the order of a hash of `order`; rows that tie in `order`, key and size are
    interchangeable, and one that is repeated very often is dealt to many tasks. An empty table gives no rows.
    """
    kept = {c: f"__k{i}" for i, c in enumerate(df.columns) if c not in ("shard", "slot")}
    by = {f"__o{i}": c for i, c in enumerate(order)}
    rows = df.select(
        *[F.col(f"`{c}`").alias(k) for c, k in kept.items()], *[c.alias(k) for k, c in by.items()],
        F.coalesce(F.unhex(F.md5(key)), F.lit(b"")).alias("__key"), size.alias("__size"), F.xxhash64(*order).alias("__at"),
    )
    shown = [F.col(k).alias(c) for c, k in kept.items()]
    groups = materialize(rows.groupBy("__key").agg(F.sum("__size").alias("__bytes"), F.count("*").alias("n")), "groups")
    n_groups, n_rows = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_groups:
        return rows.select(*shown, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    where = materialize(_assign(groups.select("__key", "__bytes"), n_groups, n_shards, pool), "assigned")
    turn = [F.col("__at").asc(), *[F.col(k).asc_nulls_first() for k in by], F.col("__key").asc(), F.col("__size").asc()]
    placed = numbered(rows.join(where, "__key"), "__shard", turn, "slots", -(-n_rows // chunk_rows))
    return placed.select(*shown, F.col("__shard").alias("shard"), F.col("pos").cast("long").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Every document's shard; equal texts stay together, and null is a text of its own, of size 1. Rows of one id are ordered by their texts, so
    that null ids are no hot chunk."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text")).alias("text_crc32"),
        F.md5("text").alias("text_md5"),
    )
    rows = materialize(rows, "digests")
    return shard(rows, F.col("text_md5"), F.col("size"), [F.col("doc_id"), F.col("text_md5")], n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
