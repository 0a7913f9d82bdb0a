import datetime as dt
import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from gleaner.functions import days
from gleaner.operators import folds, levels, sketches
from gleaner.sources import variants


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


def test_levels_by_hand(spark):
    r = random.Random(2)
    rows = [(r.choice(["x", "y", None]), r.choice([1, None]), r.choice([None, *range(9)])) for _ in range(80)]
    df = spark.createDataFrame(rows, "a string, b int, v long")
    measures = {k: (k, F.col("v")) for k in ("sum", "count", "min", "max", "avg")}
    for sets in (levels.cube(["a", "b"]), levels.rollup(["a", "b"]), [("b",), ()]):
        want = []
        for s in sets:
            keep = ["a" in s, "b" in s]
            keys = {tuple(x if k else None for x, k in zip(row[:2], keep)) for row in rows}
            for key in keys:
                v = [row[2] for row in rows if row[2] is not None and all(not k or row[i] == key[i] for i, k in enumerate(keep))]
                want.append((*key, 2 * (not keep[0]) + (not keep[1]), sum(v) if v else None, len(v), min(v, default=None), max(v, default=None), sum(v) / len(v) if v else None))
        assert rows_of(levels.levels(df, ["a", "b"], sets, measures)) == sorted(want, key=repr)
    assert levels.levels(df.limit(0), ["a", "b"], levels.cube(["a", "b"]), measures).count() == 0
    got = levels.pivoted(df, ["b"], "a", ["x", None, "q"], "count", F.col("v"))
    cell = lambda b, a: sum(x[0] == a and x[1] == b and x[2] is not None for x in rows)
    assert rows_of(got) == sorted([(b, cell(b, "x"), cell(b, None), None) for b in (1, None)], key=repr)


def test_sketches_of_days_merge_as_if_made_at_once(spark):
    n = 60_000
    df = spark.range(n).select((F.col("id") % 30).alias("day"), (F.col("id") % 2).alias("half"), (F.pmod(F.xxhash64("id"), F.lit(7000))).alias("thing"), (F.col("id") * 1.0).alias("v"))
    day = sketches.sketched(df, ["day", "half"], F.col("thing"), F.col("v"))
    (got,) = sketches.read(sketches.merged(day, [F.lit(1).alias("one")]), (0.1, 0.5, 0.99)).collect()
    true = df.select("thing").distinct().count()
    assert got["n_rows"] == n and abs(got["n_things"] - true) <= sketches.COUNT_ERROR * true
    assert all(abs(q / n - s) <= sketches.RANK_ERROR for q, s in zip(got["quantiles"], (0.1, 0.5, 0.99)))
    # A day that comes in again changes no distinct count.
    again = sketches.read(sketches.merged(day.unionByName(day.filter("day = 3")), [F.lit(1).alias("one")])).first()
    assert again["n_things"] == got["n_things"] and again["n_rows"] == n + n // 30
    odd = spark.createDataFrame([(1, None, None), (1, "a", float("nan")), (1, "a", 2.0), (2, None, None)], "g int, t string, v double")
    assert rows_of(sketches.read(sketches.sketched(odd, ["g"], F.col("t"), F.col("v")), (0.5,)), "g", "n_rows", "n_things", "quantiles") == [(1, 2, 1, [2.0]), (2, 0, 0, None)]
    assert sketches.read(sketches.sketched(odd.limit(0), ["g"], F.col("t"), F.col("v"))).count() == 0


def test_counts_keep_their_error_in_every_group(spark):
    # Of 1,500 groups of 60,000 whole numbers those that 2 ** 12 registers estimate worst.
    n, worst = 60_000, [694, 225, 1394, 72]
    df = spark.createDataFrame([(g,) for g in worst], "g long").select("g", F.explode(F.sequence(F.col("g") * n, F.col("g") * n + n - 1)).alias("id"))
    day = sketches.sketched(df, ["g", (F.col("id") % 3).alias("day")], F.col("id"), F.col("id"))
    got = sketches.read(sketches.merged(day, ["g"])).collect()
    assert len(got) == len(worst) and all(abs(r["n_things"] - n) <= 0.04875 * n for r in got)


@pytest.mark.parametrize("most", [50_000, 3])
def test_folds_by_hand(spark, monkeypatch, most):
    monkeypatch.setattr(folds, "MOST_STATES", most)
    r = random.Random(1)
    rows = [(r.choice(["k", None, 'q"', "é"]), r.choice([1, None]), r.choice([None, "http://a.b/c", "http://a.b/dé", "http://a"]), r.choice([None, 0, -12, 30, 18])) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b int, t string, n long").repartition(7)
    got = {(x["a"], x["b"]): x["v"] for x in folds.fold(df, ["a", "b"], ["t"], folds.CommonPrefix(), "v").collect()}
    gcd = {x["a"]: x["v"] for x in folds.fold(df, ["a"], ["n"], folds.Divisor(), "v").collect()}
    for a, b in product(["k", None, 'q"', "é"], [1, None]):
        texts = [x[2] for x in rows if x[:2] == (a, b) and x[2] is not None]
        prefix = texts[0][: next((i for i in range(99) if len({t[: i + 1] for t in texts}) > 1 or i >= len(min(texts, key=len))), 99)] if texts else None
        assert got[a, b] == prefix
        nums = [x[3] for x in rows if x[0] == a and x[3] is not None]
        assert gcd[a] == math.gcd(*nums)
    assert [x["v"] for x in folds.fold(df, [], ["n"], folds.Divisor(), "v").collect()] == [6]
    assert folds.fold(df.limit(0), ["a"], ["n"], folds.Divisor(), "v").count() == 0
    assert rows_of(folds.fold(df.filter("t IS NULL"), ["b"], ["t"], folds.CommonPrefix(), "v")) == [(1, None), (None, None)]


def test_states_travel_and_not_rows(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("k"), (F.col("id") * 6).alias("n"))
    out = folds.fold(df, ["k"], ["n"], folds.Divisor(), "v")
    assert out.collect()[0]["v"] == 6
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(__key") < plan.rindex("MapInArrow")  # states are made below the exchange


def test_backlog(spark):
    rows = [(1, "a", 1, 5), (2, "a", 1, -9), (3, "a", None, 2), (4, "a", 3, None), (5, None, 1, 7), (6, None, 2, -3), (7, "b", 1, -1), (8, "a", 4, 3)]
    df = spark.createDataFrame(rows, "id long, k string, t int, n long")
    assert rows_of(folds.backlog(df, "k", ["t"], "id", F.col("n"))) == [(1, 7), (2, 0), (3, 2), (4, 0), (5, 7), (6, 4), (7, 0), (8, 3)]
    assert folds.backlog(df.limit(0), "k", ["t"], "id", F.col("n")).count() == 0


def test_backlog_takes_rows_by_batches(spark):
    # A row at a time each was a table of its own; a key's rows are many batches here, and sums that don't fit are told row by row.
    assert folds.Backlog.evalType == PythonEvalType.SQL_ARROW_UDTF
    r = random.Random(4)
    rows = [(i, r.choice(["a", "b", None]), r.choice([None, r.randrange(-50, 50)])) for i in range(500)] + [(500, "c", -(2**63)), (501, "c", -(2**63)), (502, "c", 5), (503, "c", -2)]
    left, want = {}, []
    for i, k, n in rows:
        left[k] = max(0, left.get(k, 0) + (n or 0))
        want.append((i, left[k]))
    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(name, "7")
    try:
        assert rows_of(folds.backlog(spark.createDataFrame(rows, "id long, k string, n long"), "k", [], "id", F.col("n")), "id", "backlog") == sorted(want, key=repr)
    finally:
        spark.conf.set(name, before)


def test_payloads_of_all_kinds(spark, tmp_path):
    texts = ['{"k": 1, "t": "x", "d": {"e": [1, {"f": 2.5}]}}', '{"k": "2"}', '{"k": "x"}', '{"k": {"y": 1}}', '{"k": null}', "{}", "[1]", "7", "null", '{"k": 1', "", "no", None, '{"k": 9223372036854775808}']
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "id int, p string, k string")
    out = variants.shredded(df, "p", {"k": ("$.k", "bigint"), "f": ("$.d.e[1].f", "double"), "t": ("$.t", "string")})
    out.write.parquet(str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v"))
    assert back.columns == ["id", "k", "f", "t", "malformed", "mistyped", "whole"]
    got = {r["id"]: (r["k"], r["f"], r["t"], r["malformed"], r["mistyped"]) for r in back.drop("whole").collect()}
    assert got[0] == (1, 2.5, "x", False, []) and got[1] == (2, None, None, False, [])
    assert all(got[i] == (None, None, None, False, ["k"]) for i in (2, 3, 13))
    assert all(got[i] == (None, None, None, False, []) for i in (4, 5, 6, 7, 8, 12))
    assert all(got[i] == (None, None, None, True, []) for i in (9, 10, 11))
    assert back.filter("variant_get(whole, '$.d.e[0]', 'int') = 1").count() == 1


def test_days_of_a_place(spark):
    at = lambda *x: dt.datetime(*x)
    rows = [("a", at(2024, 3, 30, 22, 59)), ("a", at(2024, 3, 30, 23, 0)), ("a", at(2024, 3, 31, 21, 59)), ("a", at(2024, 4, 2, 0, 0)), ("b", None), (None, at(2024, 10, 26, 22, 0)), (None, at(2024, 10, 27, 22, 59))]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz")
    got = rows_of(days.per_day(df, F.col("t"), "Europe/Berlin", ["k"]), "k", "day", "hours", "n")
    d = dt.date
    assert got == sorted([("a", d(2024, 3, 30), 24.0, 1), ("a", d(2024, 3, 31), 23.0, 2), ("a", d(2024, 4, 1), 24.0, 0), ("a", d(2024, 4, 2), 24.0, 1), (None, d(2024, 10, 27), 25.0, 2)], key=repr)
    assert days.per_day(df.limit(0), F.col("t"), "Europe/Berlin", ["k"]).count() == 0
    # Midnight of 4 November 2018 is left out in São Paulo.
    row = spark.range(1).select(days.begins(F.lit(d(2018, 11, 4)), "America/Sao_Paulo").alias("b"), days.hours(F.lit(d(2018, 11, 4)), "America/Sao_Paulo").alias("h"), days.local_day(F.lit(at(2018, 11, 4, 3, 0)), "America/Sao_Paulo").alias("d")).first()
    assert (row["b"], row["h"], row["d"]) == (at(2018, 11, 4, 3, 0), 23.0, d(2018, 11, 4))
