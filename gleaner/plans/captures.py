"""Queries over payloads, further pages, exports and edge cases of keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import keys, searchurl
from gleaner.operators import store
from gleaner.operators.shared import spread
from gleaner.plans.registry import _INDEED, _LATEST, _LINKED, _STEPPED, _STORE_COLUMNS, _URL, _sightings, _urls, long, query
from gleaner.sources import html, payloads

# One page in four leads on to another, by the mark of its site.
_NEXT = """CASE WHEN p_partkey % 4 <> 0 THEN '' WHEN p_partkey % 3 = 0 THEN '<a aria-label="Next Page" href="#">n</a>' WHEN p_partkey % 3 = 1 THEN '<button aria-label="View next page">n</button>' ELSE '<nav><i data-at="pagination-next"></i></nav>' END"""


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'indeed' WHEN 1 THEN 'linkedin' ELSE 'stepstone' END AS site, CASE p_partkey % 3 WHEN 1 THEN 2 ELSE 1 + CAST(p_partkey % 3 = 0 AS INT) END AS n_cards, p_partkey % 4 = 0 AS has_next FROM part")
def next_page(t):
    k = F.col("p_partkey") % 3
    url = F.when(k == 0, "https://de.indeed.com/jobs?q=a+b").when(k == 1, "https://www.linkedin.com/jobs/search/?keywords=ml").otherwise("https://www.stepstone.de/jobs/data-eng/in-x")
    page = F.concat(F.when(k == 0, F.expr(_INDEED)).when(k == 1, F.expr(_LINKED)).otherwise(F.expr(_STEPPED)), F.expr(_NEXT))
    # A card without a link is one; of nested cards that share a link each is one.
    return html.next_pages(spread(t("part"), "p_partkey").select("p_partkey", url.alias("url"), page.alias("html"))).select("p_partkey", "site", "n_cards", "has_next")


_BATCH = """CASE WHEN c_custkey % 5 = 0 THEN '{"date": "x' WHEN c_custkey % 5 = 1 THEN '{"built": []}' ELSE concat('{"date": "d', c_custkey, '", "pool_size": ', c_nationkey, ', "note": null, "built": [{"rank": ', c_nationkey, ', "company": "', c_name,
'", "url": null, "flags": ["f1", "f2"], "files": {"CV": "a/', c_custkey, '.pdf", "L": ""}}], "dropped": [{"company": "c", "title": "t", "reason": "r', c_custkey, '"}]}') END"""


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'given' WHEN c_custkey % 5 = 1 THEN 'given' ELSE concat('d', c_custkey) END AS date, CASE WHEN c_custkey % 5 > 1 THEN c_nationkey END AS pool_size, '' AS note,
CASE WHEN c_custkey % 5 > 1 THEN c_name END AS company, CASE WHEN c_custkey % 5 > 1 THEN c_nationkey END AS rank, CASE WHEN c_custkey % 5 > 1 THEN 'f1,f2' END AS flags, CASE WHEN c_custkey % 5 > 1 THEN concat('CV=a/', c_custkey, '.pdf,L=') END AS files,
CASE WHEN c_custkey % 5 > 1 THEN concat('r', c_custkey) END AS reason, c_custkey % 5 = 0 AS corrupt FROM customer""")
def batch_payloads(t):
    b = payloads.parse_batch(t("customer").select("c_custkey", F.expr(_BATCH).alias("raw")), "given")
    role = F.get("built", F.lit(0))
    files = F.array_join(F.transform(role["files"], lambda f: F.concat(f["label"], F.lit("="), f["path"])), ",")
    return b.select(
        "c_custkey", "date", F.col("pool_size").cast("int").alias("pool_size"), "note", role["company"].alias("company"), role["rank"].alias("rank"), F.array_join(role["flags"], ",").alias("flags"), files.alias("files"),
        F.get("dropped", F.lit(0))["reason"].alias("reason"), "corrupt",
    )


_LETTER = """CASE WHEN s_suppkey % 4 = 0 THEN '[' WHEN s_suppkey % 4 = 1 THEN '{"date": "today", "sender": []}' ELSE concat('{"sender": ["', s_name, '", "street"], "date": "today", "recipient": ["R"], "subject": "S", "salutation": "Dear", "paragraphs": ["p ', s_suppkey, '", "q"], "closing": "Bye", "signature": "me"}') END"""


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 1 THEN concat(s_name, ',street') WHEN s_suppkey % 4 = 1 THEN '' END AS sender, CASE WHEN s_suppkey % 4 > 1 THEN concat('p ', s_suppkey, ',q') END AS paragraphs,
CASE s_suppkey % 4 WHEN 0 THEN 8 WHEN 1 THEN 6 ELSE 0 END AS n_missing, s_suppkey % 4 = 0 AS corrupt FROM supplier""")
def letter_payloads(t):
    b = payloads.parse_letter(t("supplier").select("s_suppkey", F.expr(_LETTER).alias("raw")))
    return b.select("s_suppkey", F.array_join("sender", ",").alias("sender"), F.array_join("paragraphs", ",").alias("paragraphs"), F.size("missing").alias("n_missing"), "corrupt")


@query(f"SELECT md5(string_agg(url, ',' ORDER BY first_seq)) AS jobs, count(*) AS n, 'now' AS exported_at FROM ({_LATEST})")
def export_envelope(t):
    """The jobs of one envelope, in first-seen order."""
    kept = store.latest(_sightings(t), keys.store_key(F.col("url")))
    e = store.whole_envelope(kept, F.lit("now"))
    jobs = F.from_json("envelope", "exported_at string, count bigint, jobs array<struct<url:string>>")
    return e.select(F.md5(F.array_join(jobs["jobs"]["url"], ",")).alias("jobs"), jobs["count"].alias("n"), jobs["exported_at"].alias("exported_at"))


@query(f"SELECT lower(split_part(u, '?', 1)) AS key, max(page_id) AS seq FROM (SELECT page_id, {_URL} AS u FROM pages) WHERE coalesce(u, '') <> '' GROUP BY 1")
def empty_keys(t):
    """Sightings without an address make no posting."""
    rows = _urls(t).select(*[F.lit("x").alias(c) for c in store.FIELDS if c != "url"], "url", F.lit("").alias("description"), F.col("page_id").alias("seq"))
    return store.latest(rows, keys.store_key(F.col("url"))).select("key", "seq")


@query("SELECT p_partkey, p_partkey % 3 > 0 AS searched FROM part")
def empty_keywords(t):
    kw = F.when(F.col("p_partkey") % 6 == 0, " \t").when(F.col("p_partkey") % 6 == 3, None).otherwise(F.col("p_name"))
    none = F.lit(None)
    found = [searchurl.search_url(F.lit(s), kw, none.cast("string"), none.cast("int"), none.cast("int"), none.cast("boolean")) for s in ("stepstone", "linkedin", "indeed")]
    return t("part").select("p_partkey", (found[0].isNotNull() & found[1].isNotNull() & found[2].isNotNull()).alias("searched"))


@query(_LATEST)
def delivered_twice(t):
    """Batches that come again, the earlier after the later, change nothing."""
    s = _sightings(t)
    key = keys.store_key(F.col("url"))
    one = store.latest(s, key)
    return store.upsert(store.upsert(one, s.filter("seq >= 5000")), s.filter("seq < 5000")).select(*_STORE_COLUMNS)
