import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators.asof import asof
from gleaner.operators.intervals import inside_any, islands, overlapping
from gleaner.operators.sessions import sessions
from gleaner.streaming import windows


def of(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute_asof(left, right, strict, most):
    out = []
    for i, k, t, *_ in left:
        hits = [(r[2], r[3] is not None, r[3] or 0, r[4]) for r in right if None not in (k, t, r[1], r[2]) and r[1] == k and (r[2] < t or r[2] == t and not strict)]
        best = max(hits, key=lambda h: h[:3], default=None)
        out.append((i, best[3] if best and (most is None or t - best[0] <= most) else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("strict, most, keys", [(False, None, 5), (True, None, 5), (False, 3, 5), (True, 2, 1)])
def test_asof_against_all_pairs(spark, strict, most, keys):
    r = random.Random(keys)
    pick = lambda n: None if r.random() < 0.1 else r.randrange(n)
    left = [(i, pick(keys), pick(40), 1) for i in range(150)]
    right = [(i, pick(keys), pick(40), seq, f"v{i}") for i, seq in enumerate(r.sample(range(1000), 149) + [None])]
    L, R = of(spark, left, "id int, k int, t long, matched int"), of(spark, right, "id int, k int, t long, seq int, value string")
    got = asof(L, R, ["k"], F.col("t"), F.col("t"), ["value"], F.col("seq"), None if most is None else F.lit(most), strict)
    assert got.columns == ["id", "k", "t", "matched"]
    assert sorted(((x["id"], x["matched"] and x["matched"]["value"]) for x in got.collect()), key=repr) == brute_asof(left, right, strict, most)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_asof_of_nothing_repeats_and_null_values(spark):
    kind = "k int, t long, v string"
    one, none = of(spark, [(1, 5, "a")] * 3, kind), of(spark, [], kind)
    t = F.col("t")
    assert asof(none, one, ["k"], t, t, ["v"]).count() == 0
    assert [x["matched"] for x in asof(one, none, ["k"], t, t, ["v"]).collect()] == [None] * 3
    got = asof(one, of(spark, [(1, 5, None), (1, 4, "x")], kind), ["k"], t, t, ["v"])
    assert [x["matched"]["v"] for x in got.collect()] == [None] * 3  # a match whose value is null is one


def test_asof_of_one_key_over_many_parts(spark):
    left = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 10 + 5).alias("t"), "id")
    right = spark.range(0, 20_000, 500).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("t"), F.col("id").alias("v"))
    got = asof(left, right, ["k"], F.col("t"), F.col("t"), ["v"])
    assert got.filter(F.col("matched.v") != F.expr("id div 500 * 500")).count() == 0 and got.count() == 20_000


def spans(r, n):
    out = []
    for i in range(n):
        s = r.randrange(-500, 500)
        out.append((i, None if r.random() < 0.05 else r.randrange(3), None if r.random() < 0.05 else s, s + r.choice([-3, 0, 1, 2, 9, 70, 900])))
    return [*out, out[0]]


@pytest.mark.parametrize("spread, keyed", [(1, True), (3, True), (1, False)])
def test_pairs_of_spans_come_once(spark, spread, keyed):
    r = random.Random(spread)
    a, b = spans(r, 120), spans(r, 90)
    kind = "id int, k int, s long, e long"
    span, on = (F.col("s"), F.col("e")), [F.col("k")] if keyed else []
    got = overlapping(of(spark, a, kind), of(spark, b, kind), span, span, on, on, spread)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    real = lambda x: x[2] is not None and x[3] > x[2] and not (keyed and x[1] is None)
    want = [(x[0], y[0]) for x in a for y in b if real(x) and real(y) and (not keyed or x[1] == y[1]) and x[2] < y[3] and y[2] < x[3]]
    assert sorted((x["a"]["id"], x["b"]["id"]) for x in got.collect()) == sorted(want)
    assert overlapping(of(spark, a, kind), of(spark, [], kind), span, span, on, on, spread).count() == 0


@pytest.mark.parametrize("touching", [True, False])
def test_islands_and_points_in_them(spark, touching):
    r = random.Random(4)
    rows = spans(r, 60)
    kind = "id int, k int, s long, e long"
    got = islands(of(spark, rows, kind), ["k"], F.col("s"), F.col("e"), [F.count("*").alias("n")], touching)
    want = []
    for k in range(3):
        for s, e in sorted((x[2], x[3]) for x in rows if x[1] == k and x[2] is not None and x[3] > x[2]):
            if want and want[-1][0] == k and (s <= want[-1][2] if touching else s < want[-1][2]):
                want[-1] = (k, want[-1][1], max(e, want[-1][2]), want[-1][3] + 1)
            else:
                want.append((k, s, e, 1))
    assert sorted(tuple(x) for x in got.select("k", "start", "end", "n").collect()) == sorted(want)
    points = [(i, r.choice([0, 1, 2, None]), r.choice([None, *range(-600, 600)])) for i in range(200)]
    inside = inside_any(of(spark, points, "id int, k int, t long"), F.col("t"), of(spark, rows, kind), F.col("s"), F.col("e"), ["k"])
    if touching:
        hit = lambda k, t: next(((w[1], w[2]) for w in want if w[0] == k and t is not None and w[1] <= t < w[2]), None)
        assert sorted((x["id"], x["island"] and tuple(x["island"])) for x in inside.collect()) == [(i, hit(k, t)) for i, k, t in points]
    assert islands(of(spark, [], kind), ["k"], F.col("s"), F.col("e")).count() == 0


AT = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
EVENT = "id int, k string, at timestamp"


def put(folder, n, rows):
    (folder / f"{n}.json").write_text("\n".join(json.dumps({"id": i, "k": k, "at": (AT + dt.timedelta(minutes=m)).strftime("%Y-%m-%dT%H:%M:%SZ")}) for i, k, m in rows))


def minutes(x):
    return int((x.replace(tzinfo=dt.timezone.utc) - AT).total_seconds() // 60)


def test_sessions_of_a_stream_are_those_of_the_batch_but_for_late_rows(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    batches = [[(1, "a", 0), (2, "a", 25), (3, "b", 3), (0, None, 1)], [(4, "a", 55), (5, "a", 40), (6, "b", 33)], [(7, "c", 300)], [(8, "b", 10), (9, "c", 310), (10, "c", 340)], [(11, "d", 900)]]
    for n, rows in enumerate(batches):
        put(inbox, n, rows)
        stream = spark.readStream.schema(EVENT).json(str(inbox))
        made = windows.stream_sessions(stream, ["k"], "at", "30 minutes", "1 hour", {"n": F.count("*")})
        windows.run_once(made, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted((x["k"], minutes(x["start"]), minutes(x["end"]), x["n"]) for x in spark.read.schema(made.schema).parquet(str(tmp_path / "out")).collect())
    late = {8}  # minute 10, when the watermark stood at 240
    rows = [x for b in batches for x in b if x[0] not in late]
    batch = sessions(of(spark, [(i, k, m) for i, k, m in rows], "id int, k string, m long"), ["k"], F.col("m"), 30, [F.count("*").alias("n")])
    closed = sorted(tuple(x) for x in batch.filter("end <= 900 - 60").select("k", "start", "end", "n").collect())
    assert got == closed == [("a", 0, 85, 4), ("b", 3, 63, 2), ("c", 300, 370, 3)]  # a pause of exactly the gap is none


@pytest.mark.parametrize("how", ["inner", "leftOuter"])
def test_two_streams(spark, tmp_path, how):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    steps = [([(1, "x", 0), (2, "x", 20), (3, None, 0), (4, "y", 5)], [(1, "x", 30)]), ([(5, "x", 600)], [(2, "x", 15), (3, "y", 66), (4, "z", 600)]), ([(6, "x", 1), (7, "z", 1200)], [(5, "x", 2), (6, "z", 1200)]), ([(8, "q", 1300)], [(7, "q", 1300)])]
    for n, (left, right) in enumerate(steps):
        put(a, n, left), put(b, n, right)
        s = lambda f: spark.readStream.schema(EVENT).json(str(f))
        pairs = windows.stream_pairs(s(a), s(b), ["k"], "at", "at", "30 minutes", "1 hour", how)
        windows.run_once(pairs, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted(((x["a"]["id"], x["b"] and x["b"]["id"]) for x in spark.read.schema(pairs.schema).parquet(str(tmp_path / "out")).collect()), key=repr)
    # Row 6 on the left and row 5 on the right are late: both watermarks stood at 540.
    inner = [(1, 1), (1, 2), (2, 1), (7, 6), (8, 7)]
    alone = [(4, None), (5, None)] + ([(3, None)] if (3, None) in got else [])
    assert got == sorted(inner + (alone if how == "leftOuter" else []), key=repr)
