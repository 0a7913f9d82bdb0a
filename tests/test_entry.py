import importlib
import sys

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def names():
    from gleaner.plans import captures, extras, screening, service, summaries, temporal, vectors  # noqa: F401
    from gleaner.plans.registry import QUERIES

    return sorted(n for n, (_, sql) in QUERIES.items() if sql)


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", names())
def test_same_rows_as_sql(spark, duck, name):
    from gleaner.plans.registry import QUERIES

    q, sql = QUERIES[name]
    df = q(spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    r = duck.execute(sql)
    have = [d[0] for d in r.description]
    assert sorted(have) == cols
    assert got == sorted((tuple(plain(row[have.index(c)]) for c in cols) for row in r.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_optional_parts(monkeypatch):
    real = importlib.util.find_spec

    def without(name, *a):
        if name.startswith("gleaner.llm"):
            raise ModuleNotFoundError(name)
        return None if name == "corpus_pipeline" else real(name, *a)

    monkeypatch.setattr(importlib.util, "find_spec", without)
    assert not [q for q in __spark_entry__.queries() if q.startswith("op") or q == "pipeline"]
    assert "upsert" in __spark_entry__.oracle_sql()
    assert sys.modules["__spark_entry__"]
