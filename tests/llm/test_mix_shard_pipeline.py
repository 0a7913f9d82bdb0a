import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import mixing, sharding

KIND = "doc_id bigint, text string, source string"


def test_sainte_lague_against_one_seat_at_a_time():
    rng = random.Random(1)
    for _ in range(50):
        w = [rng.choice([0, 1, 5, rng.random() * 100]) for _ in range(rng.randrange(1, 9))]
        seats = rng.randrange(0, 60)
        q = [0] * len(w)
        for _ in range(seats if sum(w) else 0):
            q[max(range(len(w)), key=lambda i: (w[i] / (2 * q[i] + 1), -i))] += 1
        assert mixing.sainte_lague(w, seats).tolist() == q


def test_targets_are_capped_and_shared_again():
    assert np.allclose(mixing.fill([100, 100, 100], [5, 2, 1], 3), [187.5, 75, 37.5])
    assert np.allclose(mixing.fill([10, 1000, 10], [5, 2, 1], 3), [30, 960, 30])
    assert mixing.fill([0, 0], [5, 2], 3).tolist() == [0, 0] and len(mixing.fill([], [], 3)) == 0


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 90)), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(600)]
    rows += [(None, None, "a"), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame(rows, KIND).withColumn("target", F.lit("clash"))
    out = mixing.mix_documents(df).collect()
    assert len(out) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    by_id = {i: s for i, _, s in rows}
    for r in out:
        s = by_id[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    names = ["a", "b", "c", None]
    want = mixing.fill([size[s] for s in names], [5, 2, 1, 5], 3)
    for s, t in zip(names, want):
        assert abs(target[s] - t) < 1e-6 and abs(taken[s] - t) <= 40
    assert sorted(map(repr, mixing.mix_documents(df.repartition(7)).collect())) == sorted(map(repr, out))
    assert mixing.mix_documents(df.limit(0)).collect() == []


def test_any_number_of_sources(spark):
    """The search by sums gives what the driver gives."""
    rng = random.Random(8)
    rows = [(i, rng.choice(["s", "ä", "z", "b"]) + str(min(rng.randrange(40), rng.randrange(40))), rng.randrange(0, 300)) for i in range(900)] + [(901, None, 50), (902, "none", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n bigint")
    one, many = (sorted(map(tuple, mixing.mix(df, F.col("source"), [F.col("doc_id")], F.col("n"), max_sources=m).collect())) for m in (1000, 2))
    assert [(*x[:5], x[6]) for x in one] == [(*x[:5], x[6]) for x in many]
    assert np.allclose([x[5] for x in one], [x[5] for x in many])
    assert mixing.mix(df.limit(0), F.col("source"), [F.col("doc_id")], F.col("n"), max_sources=-1).collect() == []


def test_differencing():
    sums, place = sharding.difference(np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]]))
    assert sorted(sums.tolist()) == [14, 16]  # the method's own answer for this list
    got = [0, 0]
    for v, p in zip([8, 7, 6, 5, 4], place[:, 0]):
        got[p] += v
    assert got == sums.tolist()
    rng = np.random.default_rng(1)
    values = rng.integers(1, 10_000, 500)
    parts = np.zeros((500, 8), dtype=np.int64)
    parts[:, 0] = values
    sums, place = sharding.difference(parts)
    assert sums.sum() == values.sum() and sums.max() - sums.min() <= 20
    assert np.bincount(place[:, 0], weights=values, minlength=8).tolist() == sums.tolist()


def test_shards(spark):
    rng = random.Random(3)
    rows = [(i, "t" * rng.randrange(0, 300), "s") for i in range(500)] + [(500 + i, "hot text", "s") for i in range(250)] + [(None, None, "s"), (1, None, None), (9, "é", "s"), (9, "é", "s")]
    df = spark.createDataFrame(rows, KIND).withColumn("slot", F.lit(5))
    for pool in (sharding.POOL, 20):  # one level, and three
        out = sharding.shard(df.withColumn("size", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")), F.col("text"), F.col("size"), [F.col("doc_id")], 8, pool=pool, chunk_rows=50).collect()
        assert len(out) == len(rows)
        where, slots, total = {}, defaultdict(list), defaultdict(int)
        for r in out:
            assert where.setdefault(r["text"], r["shard"]) == r["shard"]
            slots[r["shard"]].append(r["slot"])
            total[r["shard"]] += r["size"]
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(total.values()) - min(total.values()) <= 60
    q = {(r["doc_id"], r["size"], r["text_crc32"], r["law"]) for r in sharding.shard_documents(df).collect()}
    import zlib

    assert (9, 3, zlib.crc32("é".encode()), "bytes") in q and (1, 1, None, "bytes") in q
    assert sharding.shard_documents(df.limit(0)).collect() == []


def test_pipeline(spark, tmp_path):
    rng = random.Random(5)
    en, de = ["the", "and", "with", "there", "thing", "going", "about"], ["der", "und", "nicht", "schön", "über", "machen", "auch"]
    rows = []
    for i in range(120):
        w = rng.choices(en if i % 3 else de, k=rng.randrange(30, 60))
        rows.append((i, " ".join(w), "en" if i % 3 else "de", f"s{i % 4}", 0, 1, "x"))
    leak = "zebra yak xenon walrus violet umbra tango sierra romeo quebec papa"
    rows += [(200, rows[5][1] + " " + leak + " going there", "en", "s1", 0, 1, "x"), (201, leak, "en", "s1", 0, 1, "x"), (202, rows[7][1], "en", "s2", 0, 1, "x"), (203, "123 456", "en", "s2", 0, 1, "x"), (204, None, None, None, None, None, None), (205, "", "de", "s0", 0, 1, "x")]
    rows.append(rows[9])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, shard string")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, d)
        if name != "shards":
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/{name}")
        now = spark.read.parquet(f"{d}/{name}")
        seen.append({r["doc_id"]: r["text"] for r in now.collect()})
    assert set(range(120)) <= set(seen[0]) and not {203, 204, 205} & set(seen[0])
    assert 202 not in seen[1] and {7, 200, 201} <= set(seen[1])
    assert 201 not in seen[2] and "yak" not in seen[2][200] and seen[2][200].startswith(rows[5][1]) and seen[2][7] == rows[7][1]
    assert set(seen[4]) == set(seen[3]) <= set(seen[2])
    assert now.select("shard").distinct().count() == 8
    assert corpus_pipeline.run(spark, d).count() == now.count()
    (tmp_path / "none").mkdir()
    docs.limit(0).write.parquet(f"{d}/none/documents.parquet")
    spark.read.parquet(f"{d}/benchmark.parquet").write.parquet(f"{d}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{d}/none").collect() == []
