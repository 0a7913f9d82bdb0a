"""The store's own life as queries: pushing, streaming in, resending, status and reset, and payloads read as files of text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import keys
from gleaner.operators import gate, store
from gleaner.operators.shared import shared_dir
from gleaner.plans.facade import Service
from gleaner.plans.registry import _CV, _LATEST, _SIGHT, _STORE_COLUMNS, _cvs, _sightings, query
from gleaner.sources import payloads, schema
from gleaner.streaming import ingest


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/gleaner-service-{uuid.uuid4().hex}"


def _full(t) -> DataFrame:
    """Sightings of the schema that is handed over."""
    return _sightings(t).withColumns({"page_no": F.lit(None).cast("int"), "pos": F.lit(None).cast("int")}).select(*schema.struct(schema.SIGHTING).names)


@query(_LATEST)
def stream_upsert(t):
    """Sightings handed over as files and streamed into a store, two files a batch; those of one posting are in one file, since a store takes batches in the order in which they come."""
    rows = _full(t)
    spark, here = rows.sparkSession, _folder(rows.sparkSession)
    rows.repartition(6, keys.store_key(F.col("url"))).write.json(f"{here}/inbox")
    kept = ingest.postings_store(spark, f"{here}/store", 8)
    ingest.ingest(ingest.read_sightings(spark, f"{here}/inbox", 2), kept, f"{here}/checkpoint", once=True).awaitTermination()
    return kept.read().select(*_STORE_COLUMNS)


@query(f"SELECT title, company, location, url, 's' AS source, 'q' AS query, description, seq FROM ({_LATEST})")
def resent(t):
    """All that is stored handed over again, as the receiver reads it."""
    rows = _full(t)
    spark, here = rows.sparkSession, _folder(rows.sparkSession)
    kept = ingest.postings_store(spark, f"{here}/store", 8)
    ingest.ingest_batch(kept, rows)
    ingest.resend(kept, f"{here}/out")
    return spark.read.schema(schema.SIGHTING).json(f"{here}/out").select(*store.FIELDS, "description", "seq")


# A service that has had two pushes: sightings by even users, then all; and a list of applied addresses, some of which are stored.
_KEYS = f"SELECT DISTINCT lower(split_part(url, '?', 1)) AS key, CAST(regexp_extract(url, 'J(\\d+)', 1) AS BIGINT) AS u FROM ({_SIGHT})"


def _service(t) -> Service:
    rows = _full(t)
    s = Service(rows.sparkSession, _folder(rows.sparkSession), 4)
    s.push(rows.filter("CAST(regexp_extract(url, 'J([0-9]+)', 1) AS BIGINT) % 2 = 0"))
    s.push(rows)
    return s


def _applied(t) -> DataFrame:
    """An address of each page, by its id: pages of different ids may have one url."""
    return t("pages").select(F.concat(F.lit("https://x.example/J"), "page_id").alias("url"), F.col("page_id").alias("seq"))


@query(f"SELECT (SELECT max(seq) FROM ({_SIGHT})) AS seq, (SELECT count(*) FROM ({_SIGHT})) AS sent, count(*) FILTER (WHERE u % 2 = 1) AS added, count(*) AS total FROM ({_KEYS})")
def last_push(t):
    """What is kept of the last push, and how many postings there are."""
    s = _service(t)
    return s.last_push.read().withColumn("total", F.lit(s.postings.read().count()))


@query(f"""SELECT (SELECT count(DISTINCT page_id) FROM pages) AS applied, (SELECT count(*) FROM ({_LATEST}) WHERE first_seq >= 50) AS collected_today, 0 AS built, CAST(NULL AS VARCHAR) AS latest_batch,
(SELECT count(*) FROM ({_LATEST}) WHERE url NOT IN (SELECT concat('https://x.example/J', page_id) FROM pages)) AS matches""")
def service_status(t):
    """The status after pushes and a list of applied addresses that was sent twice."""
    s, urls = _service(t), _applied(t)
    s.applied(urls)
    s.applied(urls)
    return s.status(50).select("applied", "collected_today", "built", "latest_batch", F.col("last_rank.matches").alias("matches"))


@query(f"SELECT count(*) AS archived, 0 AS n_left, (SELECT count(DISTINCT page_id) FROM pages) AS applied FROM ({_KEYS})")
def service_reset(t):
    """A reset empties the postings, which stay archived, and leaves the applied list."""
    s = _service(t)
    s.applied(_applied(t))
    archived = s.reset()["archived"]
    return s.applied_list.read().agg(F.lit(archived).cast("bigint").alias("archived"), F.lit(s.postings.read().count()).cast("bigint").alias("n_left"), F.count("*").alias("applied"))


_EXPORTED = f"SELECT *, row_number() OVER (ORDER BY first_seq, key) - 1 AS place FROM ({_LATEST})"


@query(f"SELECT place // 20 AS part, (SELECT count(*) FROM ({_EXPORTED})) AS count, count(*) AS n, md5(string_agg(concat(url, ' ', description), ',' ORDER BY place)) AS jobs, 'now' AS exported_at FROM ({_EXPORTED}) GROUP BY 1")
def export_parts(t):
    """The export in envelopes of twenty postings."""
    out = store.envelope_parts(store.latest(_sightings(t), keys.store_key(F.col("url"))), F.lit("now"), 20)
    e = F.from_json("envelope", "exported_at string, count bigint, jobs array<struct<url:string,description:string>>")
    told = out.select("part", "count", e.alias("e"))
    jobs = F.transform("e.jobs", lambda j: F.concat(j["url"], F.lit(" "), j["description"]))
    return told.select("part", "count", F.size("e.jobs").cast("bigint").alias("n"), F.md5(F.array_join(jobs, ",")).alias("jobs"), F.col("e.exported_at").alias("exported_at"))


def _cv_texts(t) -> DataFrame:
    """Each customer's CV as a text: JSON as it stands in a file, sections by type; one in eleven cut off."""
    item = lambda s: F.when(s["type"] == "skills", F.to_json(F.array(F.array(F.lit("L"), s["title"])))).otherwise(F.to_json(s["items"]))
    one = F.transform("sections", lambda s: F.concat(F.lit('{"type": "'), s["type"], F.lit('", "title": "'), s["title"], F.lit('", "items": '), item(s), F.lit("}")))
    text = F.concat(F.lit('{"name": "N", "sections": ['), F.array_join(one, ", "), F.lit("]}"))
    return _cvs(t).select("path", text.alias("raw")).selectExpr(
        "path", "CASE WHEN CAST(path AS BIGINT) % 11 = 0 THEN left(raw, length(raw) - 1) ELSE raw END AS raw"
    )


_READ = f"SELECT * FROM ({_CV}) WHERE c % 11 <> 0"


@query(f"SELECT CAST(c AS VARCHAR) AS path, b AS bullet FROM (SELECT c, unnest([concat('<b>A:</b> ', k), concat('b ', k)]) AS b FROM ({_READ}) WHERE type = 'experience')")
def cv_payload_bullets(t):
    """Bullets of CVs that are read from JSON texts."""
    return gate.bullets(payloads.parse_cv(_cv_texts(t))).select("path", "bullet")


@query(f"""SELECT CAST(c AS VARCHAR) AS path, count(*) FILTER (WHERE c % 11 <> 0) AS n_sections, count(*) FILTER (WHERE type = 'skills' AND c % 11 <> 0) AS n_skills, c % 11 = 0 AS corrupt,
CASE WHEN c % 11 = 0 THEN 'name,sections' ELSE '' END AS missing FROM ({_CV}) GROUP BY c""")
def cv_payloads(t):
    """What is read of each CV: its sections, those of pairs, and what is missing of a text that is cut off."""
    cv = payloads.parse_cv(_cv_texts(t))
    n = lambda c: F.coalesce(c.cast("bigint"), F.lit(0))
    pairs = F.filter("sections", lambda s: s["skills"].isNotNull())
    return cv.select("path", n(F.size("sections")).alias("n_sections"), n(F.size(pairs)).alias("n_skills"), "corrupt", F.array_join("missing", ",").alias("missing"))


_LABELLED = f"SELECT CAST(c AS VARCHAR) AS path, count(*) AS n FROM ({_READ}) WHERE type = 'experience' GROUP BY c"


@query(f"""SELECT path, 'over_limit' AS rule, concat(path, ': ''A'' appears ', n, ' times, limit is 2') AS problem FROM ({_LABELLED}) WHERE n > 2 UNION ALL SELECT path, 'too_few', concat(path, ': only 1 distinct projects, minimum is 3') FROM ({_LABELLED})
UNION ALL SELECT path, 'no_labels', concat(path, ': no labelled bullets found') FROM (SELECT DISTINCT CAST(c AS VARCHAR) AS path FROM ({_CV})) WHERE path NOT IN (SELECT path FROM ({_LABELLED}))""")
def cv_payload_problems(t):
    """The gate's problems of CVs that are read from JSON texts."""
    cvs = payloads.parse_cv(_cv_texts(t))
    return gate.problems(cvs, gate.labels(gate.bullets(cvs)))
