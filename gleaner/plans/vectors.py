"""Nearest neighbours of every fiftieth vector among all: exactly, and by an inverted file at a stated recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import vectors
from gleaner.plans.registry import query

K, RECALL = 10, 0.95

_NEAREST = f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(distance, 6) AS distance FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
SELECT q.vec_id AS query_id, e.vec_id AS id, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2]))) AS distance
FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id)) WHERE rank <= {K}"""


def _asked(t):
    return t("embeddings").filter("vec_id % 50 = 0")


@query(_NEAREST)
def vector_neighbours(t):
    return vectors.exact(t("embeddings"), _asked(t), "vec_id", "embedding", K).withColumn("distance", F.round("distance", 6))


def _search(t):
    index = vectors.build(t("embeddings"), "vec_id", "embedding")
    probes = vectors.probes_for(index, _asked(t), "vec_id", "embedding", K, RECALL)
    return vectors.search(index, _asked(t), "vec_id", "embedding", K, probes)


@query(None)
def vector_search(t):
    """The same by an inverted file, with as many probes as find 95 % of the neighbours of some of the queries."""
    return _search(t).withColumn("distance", F.round("distance", 6))


@query(f"""SELECT count(*) AS n_queries, count(*) * least({K}, (SELECT count(*) - 1 FROM embeddings)) AS n_neighbours, true AS recall_enough FROM embeddings WHERE vec_id % 50 = 0""")
def vector_recall(t):
    """Whether vector_search has 90 % of the true neighbours of all queries."""
    true = vectors.exact(t("embeddings"), _asked(t), "vec_id", "embedding", K).select("query_id", "id")
    hit = true.join(_search(t).select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_neighbours"), F.coalesce(F.sum("hit") >= 0.9 * F.count("*"), F.lit(True)).alias("recall_enough"))
