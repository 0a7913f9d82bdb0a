import json

import duckdb
from pyspark.sql import functions as F

from gleaner.operators import batch, store
from gleaner.operators.shared import placed
from gleaner.sources import schema


def posting(i, seq):
    return (f"k{i}", f"t{i}", None, "", f"http://x/{i}", "s", "q", "d", seq, seq)


def test_export_in_parts(spark):
    rows = [posting(i, seq) for i, seq in enumerate([5, 3, None, 3, 9, 1, 2])]
    df = spark.createDataFrame(rows, schema.POSTING)
    parts = sorted(store.envelope_parts(df, F.lit("now"), 3).collect())
    got = [json.loads(r["envelope"]) for r in parts]
    assert [r["part"] for r in parts] == [0, 1, 2] and all(r["count"] == e["count"] == 7 and e["exported_at"] == "now" for r, e in zip(parts, got))
    assert [j["url"][-1] for e in got for j in e["jobs"]] == list("2561304") and [len(e["jobs"]) for e in got] == [3, 3, 1]
    whole = json.loads(store.whole_envelope(df, F.lit("now")).first()["envelope"])
    assert whole["jobs"] == [j for e in got for j in e["jobs"]]
    assert store.envelope_parts(df.limit(0), F.lit("now")).count() == 0


def test_places_of_many_ties_over_many_parts(spark):
    df = spark.range(30_000).select("id", (F.col("id") % 3).alias("rank"))
    got = placed(df, [F.col("rank").asc(), F.col("id").asc()])
    assert got.count() == 30_000 and got.filter("place <> rank * 10000 + id div 3 + 1").count() == 0
    same = placed(df.select("rank"), [F.col("rank").asc()])
    assert same.agg(F.count_distinct("place"), F.min("place"), F.max("place")).first() == (30_000, 1, 30_000)
    assert placed(df.limit(0), [F.col("id").asc()]).count() == 0


def test_rank_places(spark):
    df = spark.createDataFrame([(3, 1), (0, 2), (None, 3), (3, 4), (1, 5)], "rank int, input_pos int")
    got = sorted((r["place"], r["input_pos"], r["rank_key"]) for r in batch.rank_places(df).collect())
    assert got == [(1, 5, 1), (2, 1, 3), (3, 4, 3), (4, 2, 99), (5, 3, 99)]


def test_pages_of_one_url_are_applied_to_one_by_one(spark, tmp_path):
    from gleaner.plans import service  # noqa: F401  registers itself
    from gleaner.plans.registry import QUERIES

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 1_000_000)).write.parquet(f"{tmp_path}/pages.parquet")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    query, sql = QUERIES["service_reset"]
    duck = duckdb.connect()
    for t in ("pages", "events"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert [tuple(r) for r in query(spark, str(tmp_path)).select("archived", "n_left", "applied").collect()] == duck.execute(sql).fetchall()
