"""Functions of a user's own, payloads without a fixed form, calendar days, captures in files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleaner.functions import days
from gleaner.operators import folds
from gleaner.operators.shared import shared_dir
from gleaner.plans.registry import query
from gleaner.sources import pagestore, pdfs, variants

_HOST = "regexp_extract(url, '://([^/?#]+)', 1)"


@query(f"""SELECT host, left(a, list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i)))) AS prefix FROM (
SELECT {_HOST} AS host, min(CASE WHEN page_id % 11 <> 0 THEN url END) AS a, max(CASE WHEN page_id % 11 <> 0 THEN url END) AS b FROM pages GROUP BY 1)""")
def common_prefixes(t):
    """What the addresses of a host begin with, by an aggregate with partial states."""
    rows = t("pages").select(F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"), F.when(F.col("page_id") % 11 != 0, F.col("url")).alias("url"))
    return folds.fold(rows, ["host"], ["url"], folds.CommonPrefix(), "prefix")


@query("""SELECT p, CAST(CASE WHEN count(q) > 0 THEN list_reduce(list(q) FILTER (WHERE q IS NOT NULL), lambda a, b: gcd(a, b)) END AS BIGINT) AS divisor FROM (
SELECT CASE WHEN l_partkey % 5 <> 0 THEN l_partkey % 700 END AS p, CASE WHEN l_partkey % 7 <> 0 THEN CAST(l_quantity AS BIGINT) * (l_partkey % 700) END AS q FROM lineitem) GROUP BY p""")
def common_divisors(t):
    rows = t("lineitem").selectExpr("CASE WHEN l_partkey % 5 <> 0 THEN l_partkey % 700 END AS p", "CASE WHEN l_partkey % 7 <> 0 THEN CAST(l_quantity AS BIGINT) * (l_partkey % 700) END AS q")
    return folds.fold(rows, ["p"], ["q"], folds.Divisor(), "divisor")


@query("""SELECT id, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)) AS backlog FROM (
SELECT event_id AS id, user_id, ts, CAST(sum(CASE WHEN event_id % 8 = 0 THEN 0 ELSE CAST(floor(value) AS BIGINT) - 60 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM events)""")
def event_backlog(t):
    """A user's work left after each event, by a table function over the user's events in order."""
    return folds.backlog(t("events"), "user_id", ["ts"], "event_id", F.expr("CASE WHEN event_id % 8 <> 0 THEN CAST(floor(value) AS BIGINT) - 60 END"))


# Payloads of all kinds: cut off, of another type, null, nested, absent, empty.
_PAYLOAD = """CASE event_id % 11 WHEN 0 THEN '{"k": 7' WHEN 1 THEN '{"k": "x7"}' WHEN 2 THEN '{"k": [7]}' WHEN 3 THEN '{"k": null}' WHEN 4 THEN '{"other": 1}' WHEN 5 THEN NULL WHEN 6 THEN ''
WHEN 7 THEN concat('{"a": {"name": "é', event_id, '"}, "k": "', user_id, '"}') ELSE props END"""


@query(f"""SELECT event_id, CASE WHEN json_valid(p) THEN TRY_CAST(json_extract_string(p, '$.k') AS BIGINT) END AS k, CASE WHEN json_valid(p) THEN json_extract_string(p, '$.a.name') END AS name,
coalesce(NOT json_valid(p), false) AS malformed, CASE WHEN json_valid(p) AND json_extract_string(p, '$.k') IS NOT NULL AND TRY_CAST(json_extract_string(p, '$.k') AS BIGINT) IS NULL THEN 'k' ELSE '' END AS mistyped
FROM (SELECT event_id, {_PAYLOAD} AS p FROM events)""")
def payload_paths(t):
    rows = t("events").selectExpr("event_id", f"{_PAYLOAD} AS p")
    out = variants.shredded(rows, "p", {"k": ("$.k", "bigint"), "name": ("$.a.name", "string")})
    return out.select("event_id", "k", "name", "malformed", F.array_join("mistyped", ",").alias("mistyped"))


_ZONE = "Europe/Berlin"
_LOCAL = f"CAST(timezone('{_ZONE}', timezone('UTC', o_orderdate)) AS DATE)"


@query(f"""WITH c AS (SELECT o_orderpriority, {_LOCAL} AS day, count(*) AS n FROM (SELECT o_orderpriority, o_orderdate + INTERVAL 1 MINUTE * (o_orderkey % 1440) AS o_orderdate FROM orders) GROUP BY 1, 2),
s AS (SELECT o_orderpriority, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT o_orderpriority, min(day) AS a, max(day) AS b FROM c GROUP BY 1)),
t AS (SELECT s.*, timezone('UTC', timezone('{_ZONE}', CAST(s.day AS TIMESTAMP))) AS begins, timezone('UTC', timezone('{_ZONE}', CAST(s.day + 1 AS TIMESTAMP))) AS ends FROM s)
SELECT t.o_orderpriority, strftime(t.day, '%Y-%m-%d') AS day, epoch_us(begins) AS begins, date_diff('minute', begins, ends) / 60.0 AS hours, coalesce(n, 0) AS n FROM t LEFT JOIN c ON c.day = t.day AND c.o_orderpriority = t.o_orderpriority""")
def orders_by_local_day(t):
    """Orders of each priority on each day in Berlin; days of 23, 24 and 25 hours, days without orders too."""
    at = F.expr("timestampadd(MINUTE, CAST(o_orderkey % 1440 AS INT), CAST(o_orderdate AS TIMESTAMP_NTZ))")
    out = days.per_day(t("orders"), at, _ZONE, ["o_orderpriority"])
    return out.select("o_orderpriority", F.date_format("day", "yyyy-MM-dd").alias("day"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', begins)").alias("begins"), "hours", "n")


_STORED = f"SELECT page_id, url, html, CASE WHEN page_id % 13 <> 0 THEN DATE '2024-05-01' + CAST(page_id % 5 AS INTEGER) END AS day, concat('s', page_id % 3) AS site FROM pages"


@query(f"SELECT url, strftime(day, '%Y-%m-%d') AS day, site, CAST(length(html) AS INTEGER) AS chars FROM ({_STORED}) WHERE day >= DATE '2024-05-02' AND day < DATE '2024-05-05' AND site IN ('s0', 's2') AND length(html) > 200")
def stored_pages(t):
    """All pages written as a store of captures, and those of three days and two sites read from it: the rest of the files is left alone."""
    pages = t("pages").selectExpr("url", "html", "CASE WHEN page_id % 13 <> 0 THEN date_add(DATE'2024-05-01', CAST(page_id % 5 AS INT)) END AS day", "concat('s', page_id % 3) AS site")
    folder = f"{shared_dir(pages.sparkSession)}/gleaner-pagestore-{uuid.uuid4().hex}"
    pagestore.save(pages, folder)
    found = pagestore.load(pages.sparkSession, folder).filter("day >= DATE'2024-05-02' AND day < DATE'2024-05-05' AND site IN ('s0', 's2')").filter(F.length("html") > 200)
    return found.select("url", F.date_format("day", "yyyy-MM-dd").alias("day"), "site", F.length("html").alias("chars"))


_LINES = "len(string_split(coalesce(text, ''), chr(10)))"


@query(f"""SELECT doc_id, kind IN (0, 2) AS opens, CASE kind WHEN 1 THEN 'no pointer near the end' WHEN 3 THEN 'no pointer near the end' WHEN 4 THEN 'no header' WHEN 5 THEN 'no table where the pointer points' WHEN 6 THEN 'no header' END AS problem,
CASE WHEN kind IN (0, 2) THEN CAST((greatest(1, {_LINES}) + 49) // 50 AS INTEGER) END AS pages, kind IN (2, 3) OR kind NOT IN (4, 6) AND above AS above_floor
FROM (SELECT *, doc_id % 7 AS kind, NULL AS above FROM documents)""".replace("kind IN (2, 3) OR kind NOT IN (4, 6) AND above AS above_floor", "CASE WHEN kind IN (2, 3) THEN true WHEN kind = 6 THEN false END AS above_floor"))
def pdf_checks(t):
    """A file of each document, whole, cut off, padded before its pointer and behind it, without its head, with a wrong pointer, and empty; and what verifying says of each."""
    files = pdfs.drawn(t("documents"), "doc_id", F.split(F.coalesce("text", F.lit("")), "\n"))
    kind, c = F.col("doc_id") % 7, F.col("content")
    cut = lambda a, b: F.expr(f"substring(content, {a}, {b})")
    wrong = F.encode(F.regexp_replace(F.decode(c, "ISO-8859-1"), "startxref\n(\\d+)", "startxref\n9"), "ISO-8859-1")
    content = F.when(kind == 1, cut(1, "octet_length(content) - 30")).when(kind == 2, pdfs.pad(c)).when(kind == 3, F.expr("concat(content, CAST(repeat('X', 8200) AS BINARY))"))
    content = content.when(kind == 4, cut(6, "octet_length(content)")).when(kind == 5, wrong).when(kind == 6, F.lit(b"")).otherwise(c)
    out = pdfs.verified(files.withColumn("content", content), "doc_id")
    return out.select("doc_id", "opens", "problem", "pages", F.when((F.col("doc_id") % 7).isin(2, 3, 6), F.col("above_floor")).alias("above_floor"))
