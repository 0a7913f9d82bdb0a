"""A row that is repeated very often is no large task, and nothing is left behind."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.llm import jaccard, mixing, sharding, store

N = 100_000
KIND = "doc_id bigint, text string, source string, pos string, n string"


@pytest.fixture
def rows(spark):
    few = spark.createDataFrame([(i, f"one of {i} " * 9, "b", "x", "y") for i in range(50)], KIND)
    one = spark.createDataFrame([(7, "the very same words again and again", "a", "x", "y")], KIND)
    return few.unionByName(one.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(N)))).drop("k"))


def parts_of(spark, name, before):
    """Rows in each file of the tables that were written since."""
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    tables = [d for d in os.listdir(folder) if d.startswith(f"gleaner-{name}-") and d not in before]
    return [n for d in tables for n in spark.read.parquet(f"{folder}/{d}").groupBy(F.input_file_name()).count().select("count").toPandas()["count"]]


def test_shards_of_a_row_repeated_very_often(spark, rows):
    before = os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    out = sharding.shard(rows, F.col("text"), F.octet_length("text").cast("long"), [F.col("doc_id")], 8, chunk_rows=20_000)
    assert out.columns == [*rows.columns, "shard", "slot"]
    got = out.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.count_distinct("slot").alias("slots")).collect()
    assert sum(r["n"] for r in got) == N + 50 and all((r["low"], r["high"], r["slots"]) == (0, r["n"] - 1, r["n"]) for r in got)
    assert max(parts_of(spark, "slots", before)) < N / 2


def test_a_mix_with_a_row_repeated_very_often(spark, rows):
    before = os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    out = mixing.mix_documents(rows).withColumn("source", F.when(F.col("doc_id") == 7, "a").otherwise("b"))
    taken = {r["doc_id"]: r["t"] for r in out.filter("source_size > 10000").groupBy("doc_id").agg(F.sum("taken").alias("t"), F.max(F.expr("taken - 3 * size")).alias("most")).collect()}
    target = out.filter("source_size > 10000").first()["target"]
    assert abs(taken[7] - target) <= 40 and out.filter("taken > 3 * size").count() == 0 and out.count() == N + 50
    assert max(parts_of(spark, "stream", before)) < N / 2


def test_one_of_a_row_repeated_very_often(spark, rows):
    few = rows.unionByName(spark.createDataFrame([(None, "", "c", None, None)] * 3 + [(8, " ", "c", None, None)] * 2, KIND))
    got = Counter((r["doc_id"], r["text"]) for r in jaccard.one_of_each(few).select("doc_id", "text").collect())
    assert got[7, "the very same words again and again"] == 1 and got[None, ""] == 3 and got[8, " "] == 2
    plan = jaccard.one_of_each(few)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_first" in plan


def test_scratch_tables_go(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    df = spark.createDataFrame([(i, f"w{i} x y z", "s", "x", "y") for i in range(30)], KIND)
    with store.scratch(spark):
        assert sharding.shard_documents(df).count() == 30
        assert set(os.listdir(folder)) > before
        with store.scratch(spark):
            inner = store.materialize(df, "inner")
            assert inner.count() == 30
    assert set(os.listdir(folder)) == before
