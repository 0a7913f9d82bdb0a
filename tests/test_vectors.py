import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import vectors

KIND = "id long, v array<float>, distance int, rank string"


def rows_of(n, dim=6, seed=3, hot=0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    out = [(i, [c + r.gauss(0, 0.3) for c in r.choice(centres)], 1, "x") for i in range(n)]
    return out + [(n + i, [0.5] * dim, 1, "x") for i in range(hot)]


def brute(rows, asked, k):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, *_ in rows]
    out = []
    for q, v in [(i, x) for i, x in good if i in asked]:
        best = sorted((float(((x - v) ** 2).sum()), i) for i, x in good if i != q)[:k]
        out += [(q, n + 1, i, round(d, 6)) for n, (d, i) in enumerate(best)]
    return sorted(out)


def got(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 6)) for r in df.collect())


@pytest.mark.parametrize("block, queries, hot", [(16_384, 4096, 0), (50, 7, 0), (40, 5, 150)])
def test_exact_neighbours_in_blocks(spark, monkeypatch, block, queries, hot):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "QUERIES", queries)
    rows = rows_of(200, hot=hot)
    df = spark.createDataFrame(rows, KIND)
    asked = {i for i, *_ in rows if i % 10 == 0}
    assert got(vectors.exact(df, df.filter("id % 10 = 0"), "id", "v", 5)) == brute(rows, asked, 5)
    # All cells probed are all rows.
    index = vectors.build(df, "id", "v", cells=9)
    assert got(vectors.search(index, df.filter("id % 10 = 0"), "id", "v", 5, probes=99)) == brute(rows, asked, 5)


def test_recall_is_kept_and_fewer_rows_are_looked_at(spark):
    rows = rows_of(1500, dim=8, hot=500)
    df = spark.createDataFrame(rows, KIND)
    asked = df.filter("id % 20 = 0")
    index = vectors.build(df, "id", "v", cells=24)
    assert index.rows.count() == 2000
    probes = vectors.probes_for(index, asked, "id", "v", 10, 0.95)
    assert 1 <= probes < 20
    true = {x[:1] + x[2:3] for x in brute(rows, {i for i, *_ in rows if i % 20 == 0}, 10)}
    found = {(q, i) for q, _, i, _ in got(vectors.search(index, asked, "id", "v", 10, probes))}
    assert len(true & found) >= 0.9 * len(true)
    assert vectors.probes_for(index, asked, "id", "v", 10, 1.0) >= probes


def test_vectors_that_are_none(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1, "a"), (1, [1.0, 2.0], 1, "a"), (1, [1.0, 2.0], 1, "a"), (2, None, 1, "a"), (3, [], 1, "a"), (4, [1.0], 1, "a"), (5, [nan, 1.0], 1, "a"), (6, [inf, 1.0], 1, "a"), (7, [None, 1.0], 1, "a"), (None, [0.0, 0.0], 1, "a"), (8, [0.0, 0.0], 1, "a")]
    df = spark.createDataFrame(rows, KIND)
    assert got(vectors.exact(df, df.filter("id IN (0, 2, 5, 8)"), "id", "v", 10)) == [(0, 1, 1, 0.0), (0, 2, 1, 0.0), (0, 3, 8, 5.0), (8, 1, 0, 5.0), (8, 2, 1, 5.0), (8, 3, 1, 5.0)]
    none = df.limit(0)
    index = vectors.build(none, "id", "v")
    assert vectors.search(index, df, "id", "v", 3).count() == 0
    assert vectors.probes_for(index, none, "id", "v") == 1
    assert vectors.search(vectors.build(df, "id", "v"), none, "id", "v").count() == 0
    assert vectors.build(df, "id", "v", dim=1).rows.select("id").collect()[0]["id"] == 4


def test_plan_has_no_cross_join(spark):
    df = spark.createDataFrame(rows_of(50), KIND)
    plan = vectors.search(vectors.build(df, "id", "v", 4), df.filter("id % 10 = 0"), "id", "v")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert df.filter(vectors.usable(F.col("v"), 6)).count() == 50
