"""Queries over time: as-of and interval joins, sessions, and streams that give the rows of their batch forms. Events stand in for sightings, marks and runs of a user."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.asof import asof
from gleaner.operators.intervals import inside_any, islands, overlapping
from gleaner.operators.sessions import sessions
from gleaner.operators.shared import micros, shared_dir
from gleaner.plans.registry import QUERIES, query
from gleaner.streaming import windows

_HOUR = 3_600_000_000
_MARK, _SEEN = "event_type = 'purchase'", "event_type IN ('view', 'click')"


def _events(t):
    """Events with their hour, so that many have one time, as us."""
    return t("events").withColumn("us", micros("ts")).withColumn("hour", F.expr(f"us div {_HOUR}"))


_H = f"epoch_us(ts) // {_HOUR}"

def _ranked(same: str) -> str:
    """The latest sighting at or before a mark's hour, and the latest one before it that is no more than 48 hours old; of one hour, that of the greatest id."""
    part = "PARTITION BY user_id" if same else ""
    last = "last_value({c} IGNORE NULLS) OVER (" + part + " ORDER BY hour, {first}, event_id)"
    return f"""WITH e AS (SELECT event_id, user_id, value, {_H} AS hour, {_MARK} AS mark, CASE WHEN {_SEEN} THEN event_id END AS seen FROM events WHERE {_MARK} OR {_SEEN}),
f AS (SELECT *, {last.format(c='seen', first='mark')} AS seen_id, {last.format(c='seen', first='NOT mark')} AS earlier FROM e)
SELECT f.event_id, f.user_id, f.seen_id, s.value AS seen_value, CASE WHEN f.hour - r.hour <= 48 THEN r.event_id END AS recent_id
FROM f LEFT JOIN e s ON s.event_id = f.seen_id LEFT JOIN e r ON r.event_id = f.earlier WHERE f.mark"""


def _marked(t, on):
    e = _events(t)
    marks, seen = e.filter(_MARK).select("event_id", "user_id", "hour"), e.filter(_SEEN).select("event_id", "user_id", "hour", "value")
    hour = F.col("hour")
    out = asof(marks, seen, on, hour, hour, ["event_id", "value"], F.col("event_id"), name="seen")
    out = asof(out, seen, on, hour, hour, ["event_id"], F.col("event_id"), most=F.lit(48), strict=True, name="recent")
    return out.select("event_id", "user_id", F.col("seen.event_id").alias("seen_id"), F.col("seen.value").alias("seen_value"), F.col("recent.event_id").alias("recent_id"))


@query(_ranked("user"))
def asof_sighting(t):
    """Each mark with the latest sighting by its user."""
    return _marked(t, ["user_id"])


@query(_ranked(""))
def asof_sighting_of_any(t):
    """Each mark with the latest sighting of all: one key that has every row."""
    return _marked(t, [])


# Runs: an error begins one, which lasts as many minutes as its value, times ten; negative and missing ones are empty.
_RUN = f"CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 9 = 1 THEN 0 WHEN event_id % 9 = 2 THEN -1 ELSE 1 END * CAST(floor(value) AS BIGINT) * 600000000"


def _runs(t):
    return t("events").filter("event_type = 'error'").select(F.col("event_id").alias("run_id"), "user_id", micros("ts").alias("s"), (micros("ts") + F.expr(_RUN)).alias("e"))


_RUNS = f"SELECT event_id AS run_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + {_RUN} AS e FROM events WHERE event_type = 'error'"


@query(f"SELECT r.run_id, p.event_id FROM ({_RUNS}) r JOIN events p ON p.user_id = r.user_id AND epoch_us(p.ts) >= r.s AND epoch_us(p.ts) < r.e")
def events_in_runs(t):
    """Pairs of a run and an event of its user inside it."""
    p = t("events").withColumn("us", micros("ts"))
    at, user = F.col("us"), [F.col("user_id")]
    return overlapping(_runs(t), p, (F.col("s"), F.col("e")), (at, at + 1), user, user).select("a.run_id", "b.event_id")


@query(f"""SELECT a.run_id, b.run_id AS other_id FROM ({_RUNS}) a JOIN ({_RUNS}) b ON a.user_id % 50 = b.user_id % 50 AND a.user_id <> b.user_id AND a.s < b.e AND b.s < a.e AND a.s < a.e AND b.s < b.e""")
def overlapping_runs(t):
    """Pairs of runs by different users of a group that overlap; spread over two tasks for each bin."""
    span, group = (F.col("s"), F.col("e")), [F.col("user_id") % 50]
    return overlapping(_runs(t), _runs(t), span, span, group, group, spread=2).filter("a.user_id <> b.user_id").select("a.run_id", F.col("b.run_id").alias("other_id"))


_ISLANDS = """SELECT {key} min(s) AS "start", max(e) AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER ({part} ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS island FROM (
SELECT *, CASE WHEN s {apart} max(e) OVER ({part} ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM ({spans}))) GROUP BY {key} island"""
_GLOBAL = _ISLANDS.format(key="", part="", apart=">", spans=f"SELECT run_id AS id, s, s + (e - s) // 100 AS e FROM ({_RUNS}) WHERE s + (e - s) // 100 > s")


def _short_runs(t):
    return _runs(t).withColumn("e", F.expr("s + (e - s) div 100"))


@query(_GLOBAL)
def merged_runs(t):
    """Runs of all users together, a hundredth as long, that overlap or touch, made one."""
    return islands(_short_runs(t), [], F.col("s"), F.col("e"), [F.count("*").alias("n")])


@query(f"""SELECT p.event_id, i."start" AS since FROM events p LEFT JOIN ({_GLOBAL}) i ON epoch_us(p.ts) >= i."start" AND epoch_us(p.ts) < i."end" """)
def events_in_merged_runs(t):
    """Each event with the start of the merged run that it lies in, of whatever user."""
    p = t("events").select("event_id", micros("ts").alias("us"))
    return inside_any(p, F.col("us"), _short_runs(t), F.col("s"), F.col("e")).select("event_id", F.col("island.start").alias("since"))


_GAP = 12 * _HOUR
_SESSIONS = _ISLANDS.format(key="user_id,", part="PARTITION BY user_id", apart=">", spans=f"SELECT event_id AS id, user_id, epoch_us(ts) AS s, epoch_us(ts) + {_GAP} AS e, event_id FROM events").replace("count(*) AS n", "count(*) AS n, min(event_id) AS first_id")


def _of_session():
    return {"n": F.count("*"), "first_id": F.min("event_id")}


@query(_SESSIONS)
def user_sessions(t):
    """A user's events without a pause of twelve hours."""
    return sessions(t("events"), ["user_id"], micros("ts"), _GAP, [c.alias(n) for n, c in _of_session().items()])


@query(_ISLANDS.format(key="", part="", apart=">", spans=f"SELECT event_id AS id, epoch_us(ts) AS s, epoch_us(ts) + 60000000 AS e FROM events"))
def sessions_of_all(t):
    """Events of all users together without a pause of a minute: one key that has every row."""
    return sessions(t("events"), [], micros("ts"), 60_000_000, [F.count("*").alias("n")])


_LATE = "6 hours"


def _stream(spark: SparkSession, sf_dir: str, columns: str) -> DataFrame:
    """The events as a stream of files; a table of one file or of many."""
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    found = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parque[t]")
    return found.selectExpr(*columns.split(", "), "CAST(ts AS TIMESTAMP) AS at")


def _all_of(rows: DataFrame) -> DataFrame:
    """What a stream gives of all that it has now."""
    spark, here = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/gleaner-stream-{uuid.uuid4().hex}"
    windows.run_once(rows, f"{here}/rows", f"{here}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{here}/rows")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_sessions of a stream, those that are closed when it has come to its end: the watermark, six hours before the latest event, has passed their end."""
    rows = windows.stream_sessions(_stream(spark, sf_dir, "event_id, user_id"), ["user_id"], "at", "12 hours", _LATE, _of_session())
    return _all_of(rows).select("user_id", micros("start").alias("start"), micros("end").alias("end"), "n", "first_id")


def stream_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the purchases of its user in the three days after it, of two streams."""
    e = _stream(spark, sf_dir, "event_id, user_id, event_type")
    pairs = windows.stream_pairs(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), ["user_id"], "at", "at", "3 days", _LATE)
    return _all_of(pairs).select(F.col("a.event_id").alias("click_id"), F.col("b.event_id").alias("event_id"))


_PAIRS = "SELECT a.event_id AS click_id, b.event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 3 DAY"


@query(_PAIRS)
def pairs_in_three_days(t):
    """The batch form of stream_pairs."""
    e = t("events").withColumn("us", micros("ts"))
    us, user = F.col("us"), [F.col("user_id")]
    clicks, bought = e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'")
    return overlapping(clicks, bought, (us, us + 72 * _HOUR + 1), (us, us + 1), user, user).select(F.col("a.event_id").alias("click_id"), F.col("b.event_id").alias("event_id"))


QUERIES["stream_sessions"] = (stream_sessions, f"""SELECT * FROM ({_SESSIONS}) WHERE "end" <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - {6 * _HOUR} FROM events)""")
QUERIES["stream_pairs"] = (stream_pairs, _PAIRS)
