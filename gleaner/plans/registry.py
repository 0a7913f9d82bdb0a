"""Every operator as a query over the test tables, with SQL that gives the same rows.

The tables stand in for captured pages and batches: `pages` for addresses, `events` for
sightings, marks and runs, `part` and `lineitem` for labels of documents, `customer` for ranks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import keys, searchurl, text
from gleaner.operators import batch, collect, gate, layout, marks, run, store
from gleaner.operators.shared import spread
from gleaner.sources import html

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None) -> Callable[[Callable], Callable]:
    """Register a function of a table reader under its own name."""

    def add(f: Callable) -> Callable:
        def q(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = (q, sql)
        return f

    return add


def long(c):
    return c.cast("bigint")


# Addresses that vary in case and closing slashes, with one in five missing.
_URL = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN upper(url) WHEN 2 THEN concat(url, '//') WHEN 3 THEN concat(split_part(url, '?', 1), '///?q=1') END"


def _urls(t):
    return t("pages").select("page_id", F.expr(_URL).alias("url"))


@query(f"""SELECT page_id, lower(split_part(coalesce(u, ''), '?', 1)) AS store_key,
lower(regexp_replace(split_part(coalesce(u, ''), '?', 1), '/+$', '')) AS page_key,
lower(regexp_replace(split_part(coalesce(u, ''), '?', 1), '/$', '')) AS lookup_key, coalesce(u, '') AS mark_key
FROM (SELECT page_id, {_URL} AS u FROM pages)""")
def url_keys(t):
    u = F.col("url")
    return _urls(t).select("page_id", keys.store_key(u).alias("store_key"), keys.page_key(u).alias("page_key"), keys.lookup_key(u).alias("lookup_key"), keys.mark_key(u).alias("mark_key"))


_HOST = "regexp_extract({}, '://([^/?#]+)', 1)"


@query(f"""SELECT host, page_id FROM (SELECT page_id, {_HOST.format('url')} AS host,
row_number() OVER (PARTITION BY {_HOST.format('url')} ORDER BY page_id) AS n FROM pages) WHERE n = 1""")
def first_wins(t):
    rows = t("pages").select("page_id", F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"))
    return collect.first_wins(rows, F.col("host"), F.col("page_id")).select("host", "page_id")


_CARDS = f"""SELECT page_id % 10 AS page_no, page_id * 10 + k AS pos, CASE WHEN page_id % 7 = 0 THEN '' ELSE concat('t', page_id) END AS title, {_URL} AS url
FROM pages, (SELECT 0 AS k UNION ALL SELECT 1 AS k)"""


def _cards(t):
    one = _urls(t).select((F.col("page_id") % 10).alias("page_no"), (F.col("page_id") * 10).alias("pos"), F.when(F.col("page_id") % 7 == 0, "").otherwise(F.concat(F.lit("t"), "page_id")).alias("title"), "url")
    return collect.union_cards(one, one.withColumn("pos", F.col("pos") + 1))


_COLLECTED = f"""SELECT page_no, pos, title, url FROM (SELECT *, row_number() OVER (PARTITION BY page_no, lower(regexp_replace(split_part(url, '?', 1), '/+$', '')) ORDER BY pos) AS n
FROM ({_CARDS}) WHERE url <> '' AND title <> '') WHERE n = 1"""


@query(_COLLECTED)
def overlapping_cards(t):
    return collect.collect_cards(_cards(t)).select("page_no", "pos", "title", "url")


@query(f"SELECT page_no, count(*) AS visible FROM ({_COLLECTED}) GROUP BY page_no")
def visible_cards(t):
    return collect.visible(_cards(t))


@query(f"""SELECT title, url, 'Site' AS source, 'analyst' AS query, CASE WHEN pos % 20 = 0 THEN 'long text' ELSE '' END AS description FROM ({_COLLECTED})""")
def posting_constants(t):
    cards = collect.collect_cards(_cards(t))
    d = F.when(F.col("pos") % 20 == 0, "long text")
    return collect.with_constants(cards, F.lit("Site"), F.lit("analyst"), d).select("title", "url", "source", "query", "description")


# Sightings: a user is a posting, an event a sighting; errors come without a description.
_SIGHT = """SELECT event_id AS seq, concat('https://x.example/J', user_id, CASE WHEN event_id % 3 = 0 THEN '?ref=a' ELSE '' END) AS url, event_type AS title,
CAST(user_id % 7 AS VARCHAR) AS company, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'Berlin' END AS location, 's' AS source, 'q' AS query,
CASE WHEN event_type = 'error' THEN '' ELSE props END AS description FROM events"""


def _sightings(t):
    e = F.col("event_id")
    return t("events").select(
        e.alias("seq"), F.concat(F.lit("https://x.example/J"), "user_id", F.when(e % 3 == 0, "?ref=a").otherwise("")).alias("url"), F.col("event_type").alias("title"),
        (F.col("user_id") % 7).cast("string").alias("company"), F.when(e % 4 == 0, "").otherwise("Berlin").alias("location"), F.lit("s").alias("source"), F.lit("q").alias("query"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("props")).alias("description"),
    )


_LATEST = f"""SELECT lower(split_part(url, '?', 1)) AS key, arg_max(title, seq) AS title, arg_max(company, seq) AS company, arg_max(location, seq) AS location, arg_max(url, seq) AS url,
coalesce(arg_max(description, seq) FILTER (WHERE description <> ''), '') AS description, max(seq) AS seq, min(seq) AS first_seq FROM ({_SIGHT}) GROUP BY 1"""
_STORE_COLUMNS = ["key", "title", "company", "location", "url", "description", "seq", "first_seq"]


@query(_LATEST)
def upsert(t):
    return store.latest(_sightings(t), keys.store_key(F.col("url"))).select(*_STORE_COLUMNS)


@query(_LATEST)
def upsert_into_store(t):
    """The same rows in two steps."""
    s = _sightings(t)
    half = store.latest(s.filter("seq < 5000"), keys.store_key(F.col("url")))
    return store.upsert(half, s.filter("seq >= 5000")).select(*_STORE_COLUMNS)


@query(f"SELECT count(DISTINCT key) AS total, count(*) FILTER (WHERE description <> '') AS with_description FROM ({_LATEST})")
def store_totals(t):
    return store.totals(store.latest(_sightings(t), keys.store_key(F.col("url"))))


@query(f"""SELECT DISTINCT lower(split_part(url, '?', 1)) AS key FROM ({_SIGHT}) WHERE seq >= 200
AND lower(split_part(url, '?', 1)) NOT IN (SELECT lower(split_part(url, '?', 1)) FROM ({_SIGHT}) WHERE seq < 200)""")
def added_keys(t):
    s = _sightings(t)
    key = keys.store_key(F.col("url"))
    return store.added(store.latest(s.filter("seq < 200"), key), s.filter("seq >= 200"), key)


# Marks: clicks and signups tick and untick applied, views and purchases skipped; errors reset.
_MARK = """SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS url, CASE WHEN event_type IN ('click', 'signup') THEN 'applied' ELSE 'skipped' END AS kind,
event_type IN ('click', 'view') AS checked, event_type FROM events WHERE event_type <> 'error'"""


def _marks(t):
    e = F.col("event_type")
    return t("events").filter(e != "error").select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("url"), F.when(e.isin("click", "signup"), "applied").otherwise("skipped").alias("kind"),
        e.isin("click", "view").alias("checked"),
    )


_FOLD = """SELECT url, coalesce(arg_max(kind = 'applied' AND checked, seq) FILTER (WHERE kind = 'applied' OR checked), false) AS applied,
coalesce(arg_max(kind = 'skipped' AND checked, seq) FILTER (WHERE kind = 'skipped' OR checked), false) AS skipped FROM ({}) GROUP BY url"""
_FOLDED = _FOLD.format(_MARK)


@query(_FOLDED)
def marks_fold(t):
    return marks.fold(_marks(t))


@query(f"""SELECT count(*) FILTER (WHERE applied) AS n_applied, count(*) FILTER (WHERE NOT applied AND skipped) AS n_skipped,
count(*) FILTER (WHERE NOT applied AND NOT skipped) AS n_left, count(*) FILTER (WHERE applied) / greatest(count(*), 1) * 100 AS applied_pct,
count(*) FILTER (WHERE NOT applied AND skipped) / greatest(count(*), 1) * 100 AS skipped_pct FROM ({_FOLDED})""")
def mark_counts(t):
    return marks.counts(marks.fold(_marks(t)))


@query(_FOLD.format(f"""SELECT m.* FROM ({_MARK}) m LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS url, max(event_id) AS r FROM events WHERE event_type = 'error' GROUP BY 1) e
ON m.url = e.url WHERE r IS NULL OR seq > r"""))
def marks_after_reset(t):
    resets = t("events").filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("url"), F.col("event_id").alias("seq"))
    return marks.fold(marks.after_reset(_marks(t), resets, "url"))


@query(f"SELECT url, min(seq) AS first_seq FROM ({_MARK}) WHERE kind = 'applied' AND checked GROUP BY url")
def applied_urls(t):
    return marks.applied_urls(_marks(t))


_MARKED = f"""SELECT c_custkey, coalesce(applied, false) AS applied, coalesce(skipped, false) AS skipped, coalesce(applied, false) OR coalesce(skipped, false) AS done
FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey % 200 AS VARCHAR) END AS url FROM customer) c LEFT JOIN ({_FOLDED}) m ON coalesce(c.url, '') = m.url"""


def _marked(t):
    c = F.col("c_custkey")
    cards = t("customer").select(c, F.when(c % 11 != 0, (c % 200).cast("string")).alias("url"))
    return marks.with_marks(cards, marks.fold(_marks(t))).select("c_custkey", "applied", "skipped", "done")


@query(_MARKED)
def cards_with_marks(t):
    return _marked(t)


@query(f"SELECT c_custkey FROM ({_MARKED}) WHERE NOT done")
def hide_done(t):
    return marks.hide_done(_marked(t)).select("c_custkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def exclude_applied(t):
    return store.not_applied(t("documents").select("doc_id"), t("labels"), ["doc_id"])


_NEW = """SELECT CAST(user_id AS VARCHAR) AS url, min(event_id) AS first_seq FROM events WHERE event_id >= 300
AND user_id NOT IN (SELECT user_id FROM events WHERE event_id < 300) GROUP BY 1"""
_OLD = "SELECT CAST(user_id AS VARCHAR) AS url, min(event_id) AS first_seq FROM events WHERE event_id < 300 GROUP BY 1"


def _applied(t):
    e = t("events").select(F.col("user_id").cast("string").alias("url"), F.col("event_id").alias("seq"))
    old = e.filter("seq < 300").groupBy("url").agg(F.min("seq").alias("first_seq"))
    return store.insert_applied(old, e.filter("seq >= 300"))


@query(f"{_OLD} UNION ALL {_NEW}")
def insert_applied(t):
    return _applied(t)[0]


@query(f"SELECT count(*) AS added FROM ({_NEW})")
def insert_applied_count(t):
    return _applied(t)[1]


# Documents are orders, a bullet names its part's brand; some brands are given as topics and some bullets have no label.
_BULLET = """SELECT concat('d/', l_orderkey, '/cv.json') AS path, l_linenumber AS pos,
CASE WHEN l_partkey % 9 = 0 THEN p_name WHEN l_partkey % 13 = 0 THEN concat('<b>Evaluation ', p_size % 3, ':</b> x') ELSE concat('  <b>', p_brand, ':</b> ', p_name) END AS bullet
FROM lineitem JOIN part ON l_partkey = p_partkey"""
_LABEL = f"""SELECT path, pos, label FROM (SELECT path, pos, trim(regexp_extract(bullet, '^\\s*<b>(.*?):?</b>', 1)) AS label FROM ({_BULLET})) WHERE label <> ''"""
_FREQ = f"SELECT path, label, count(*) AS n, min(pos) AS first_pos FROM ({_LABEL}) GROUP BY path, label"
_TOPIC = "regexp_matches(lower(label), '^(" + "|".join(gate.TOPICS) + ")')"


def _bullets(t):
    j = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    k = F.col("l_partkey")
    return j.select(
        F.concat(F.lit("d/"), "l_orderkey", F.lit("/cv.json")).alias("path"), F.col("l_linenumber").alias("pos"),
        F.when(k % 9 == 0, F.col("p_name")).when(k % 13 == 0, F.concat(F.lit("<b>Evaluation "), F.col("p_size") % 3, F.lit(":</b> x")))
        .otherwise(F.concat(F.lit("  <b>"), "p_brand", F.lit(":</b> "), "p_name")).alias("bullet"),
    )


@query(_FREQ)
def label_frequency(t):
    return gate.frequency(gate.labels(_bullets(t)))


_DIR = "regexp_extract(path, '/([^/]*)/[^/]*$', 1)"
_OVER = f"SELECT path, 'over_limit' AS rule, concat({_DIR}, ': ''', label, ''' appears ', n, ' times, limit is 2') AS problem FROM ({_FREQ}) WHERE n > 2"
_PER = f"SELECT path, count(*) AS k, string_agg(CASE WHEN {_TOPIC} THEN label END, ', ' ORDER BY label) AS topics FROM ({_FREQ}) GROUP BY path"
_FEW = f"SELECT path, 'too_few' AS rule, concat({_DIR}, ': only ', k, ' distinct projects, minimum is 3') AS problem FROM ({_PER}) WHERE k < 3"
_TOPICS = f"SELECT path, 'topics' AS rule, concat({_DIR}, ': topic labels, not project names: ', topics) AS problem FROM ({_PER}) WHERE topics <> ''"
_NONE = f"SELECT path, 'no_labels' AS rule, concat(path, ': no labelled bullets found') AS problem FROM (SELECT DISTINCT path FROM ({_BULLET})) WHERE path NOT IN (SELECT path FROM ({_LABEL}))"


def _problems(t):
    b = _bullets(t)
    return gate.problems(b, gate.labels(b))


@query(_OVER)
def gate_over_limit(t):
    return _problems(t).filter("rule = 'over_limit'")


@query(_FEW)
def gate_too_few(t):
    return _problems(t).filter("rule = 'too_few'")


@query(_TOPICS)
def gate_topics(t):
    return _problems(t).filter("rule = 'topics'")


@query(_NONE)
def gate_no_labels(t):
    return _problems(t).filter("rule = 'no_labels'")


@query(f"SELECT count(*) = 0 AS ok, count(*) AS n_problems FROM ({_OVER} UNION ALL {_FEW} UNION ALL {_TOPICS} UNION ALL {_NONE})")
def gate_verdict(t):
    return gate.verdict(_problems(t))


@query("""SELECT concat('d/', o_orderkey) AS path, 'not_found' AS rule, concat('d/', o_orderkey, ': not found') AS problem FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def gate_missing_paths(t):
    path = lambda c: F.concat(F.lit("d/"), c).alias("path")
    return gate.missing_paths(t("orders").select(path("o_orderkey")), t("lineitem").select(path("l_orderkey")).distinct())


@query("SELECT row_number() OVER (ORDER BY n DESC, first_pos) AS place, label, n FROM (SELECT l_returnflag AS label, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first_pos FROM lineitem GROUP BY 1)")
def label_order(t):
    rows = t("lineitem").select(F.col("l_returnflag").alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    counted = gate.report_order(gate.frequency(rows, []), [])
    return counted.select(F.expr("row_number() OVER (ORDER BY n DESC, first_pos)").cast("bigint").alias("place"), "label", "n")


_CV = "SELECT o_custkey AS c, o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'skills' WHEN 1 THEN 'experience' ELSE 'other' END AS type FROM orders"


def _cvs(t):
    o = t("orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"))
    kind = F.when(F.col("k") % 3 == 0, "skills").when(F.col("k") % 3 == 1, "experience").otherwise("other")
    bullets = F.array(F.concat(F.lit("<b>A:</b> "), F.col("k")), F.concat(F.lit("b "), F.col("k")))
    item = F.struct(F.lit("r").alias("role"), F.lit("").alias("org"), F.lit("m").alias("meta"), bullets.alias("bullets"))
    section = F.struct("k", kind.alias("type"), F.concat(F.lit("title "), F.col("k")).alias("title"), F.array(item).alias("items"))
    return o.groupBy(F.col("c").cast("string").alias("path")).agg(F.array_sort(F.collect_list(section)).alias("sections"))


@query(f"SELECT CAST(c AS VARCHAR) AS path, b AS bullet FROM (SELECT c, unnest([concat('<b>A:</b> ', k), concat('b ', k)]) AS b FROM ({_CV}) WHERE type = 'experience')")
def experience_bullets(t):
    return gate.bullets(_cvs(t)).select("path", "bullet")


@query(f"SELECT CAST(c AS VARCHAR) AS path, count(*) AS ungated_sections FROM ({_CV}) WHERE type = 'other' GROUP BY c")
def ungated_sections(t):
    return gate.ungated_sections(_cvs(t))


_DASHED = "CASE doc_id % 4 WHEN 0 THEN concat(text, '—', '--') WHEN 1 THEN concat('--', text, '–') WHEN 2 THEN concat('{\"a--b\": 1}', text) ELSE text END"


@query(f"SELECT doc_id, CASE WHEN contains(p, '—') THEN '—' WHEN contains(p, '–') THEN '–' WHEN contains(p, '--') THEN '--' END AS dash FROM (SELECT doc_id, {_DASHED} AS p FROM documents)")
def forbidden_dash(t):
    return t("documents").select("doc_id", gate.forbidden_dash(F.expr(_DASHED)).alias("dash"))


# Text functions.
_BOLD = """CASE p_partkey % 5 WHEN 0 THEN concat('<b>', p_name, ':</b> x') WHEN 1 THEN concat('  <b> ', p_brand, ' : </b> x') WHEN 2 THEN concat('<b>', p_brand, '</b>: x')
WHEN 3 THEN concat('<b>', p_brand, '::</b>') ELSE p_name END"""


@query(f"SELECT p_partkey, trim(regexp_extract({_BOLD}, '^\\s*<b>(.*?):?</b>', 1)) AS label FROM part")
def bullet_label(t):
    return t("part").select("p_partkey", text.bullet_label(F.expr(_BOLD)).alias("label"))


_ESC = "coalesce({}, '')"
for _a, _b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
    _ESC = f"replace({_ESC}, '{_a}', '{_b}')"


@query("SELECT page_id, md5(" + _ESC.format("CASE WHEN page_id % 9 = 0 THEN NULL ELSE concat(html, '''') END") + ") AS escaped FROM pages")
def html_escape(t):
    return t("pages").select("page_id", F.md5(text.escape_html(F.when(F.col("page_id") % 9 != 0, F.concat("html", F.lit("'"))))).alias("escaped"))


_TITLE = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' ', p_name) WHEN 2 THEN concat(p_name, p_name, ' x') ELSE concat(p_name, '|', p_name) END"
_HALF = "[h FOR h IN range(len(s) // 2, 3, -1) IF (2 * h + 1 <= len(s) AND left(s, h) = substring(s, h + 2, h)) OR left(s, h) = substring(s, h + 1, h)][1]"


@query(f"SELECT p_partkey, coalesce(CASE WHEN len(s) >= 8 THEN trim(left(s, {_HALF})) END, s) AS title FROM (SELECT p_partkey, {_TITLE} AS s FROM part)")
def title_collapse(t):
    return t("part").select("p_partkey", F.expr(_TITLE).alias("s")).select("p_partkey", text.collapsed(F.col("s")).alias("title"))


_BADGED = """CASE p_partkey % 6 WHEN 0 THEN concat(p_name, ' Promoted') WHEN 1 THEN concat(p_name, ' with verification  Easy Apply') WHEN 2 THEN concat(p_name, ' New Viewed Promoted Reposted')
WHEN 3 THEN concat(p_name, ' new new new new new') WHEN 4 THEN concat(' ', p_name, 'Renew') ELSE p_name END"""
_STRIPPED = "trim(s)"
for _ in range(text.BADGE_PASSES):
    _STRIPPED = f"trim(regexp_replace({_STRIPPED}, '\\s*({'|'.join(text.BADGES)})\\s*$', '', 'i'))"


@query(f"SELECT p_partkey, {_STRIPPED} AS title FROM (SELECT p_partkey, {_BADGED} AS s FROM part)")
def badge_strip(t):
    return t("part").select("p_partkey", text.without_badges(F.expr(_BADGED)).alias("title"))


@query("""SELECT p_partkey, trim(regexp_replace(coalesce(s, ''), '[\\s\\x{00A0}\\x{2003}\\x{3000}\\x{FEFF}]+', ' ', 'g')) AS squeezed
FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE concat(chr(160), ' ', replace(p_name, ' ', concat(chr(8195), chr(10))), chr(12288), chr(65279)) END AS s FROM part)""")
def squeeze(t):
    u = lambda n: F.lit(chr(n))
    s = F.concat(u(160), F.lit(" "), F.replace("p_name", F.lit(" "), F.concat(u(8195), F.lit("\n"))), u(12288), u(65279))
    return t("part").select("p_partkey", text.squeeze(F.when(F.col("p_partkey") % 10 != 0, s)).alias("squeezed"))


@query("SELECT doc_id, md5(regexp_replace(replace(text, '.', concat('.', chr(10), chr(10), chr(10), chr(10))), '\\n{3,}', concat(chr(10), chr(10)), 'g')) AS hash FROM documents")
def few_newlines(t):
    return t("documents").select("doc_id", F.md5(text.few_newlines(F.replace("text", F.lit("."), F.lit(".\n\n\n\n")))).alias("hash"))


@query("SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS name FROM pages")
def base_name(t):
    return t("pages").select("page_id", text.base_name(F.col("url")).alias("name"))


@query("SELECT p_partkey, regexp_replace(lower(trim(concat('  ', p_name, '  ', p_brand))), '\\s+', '-', 'g') AS slug FROM part")
def slug(t):
    return t("part").select("p_partkey", text.slug(F.concat(F.lit("  "), "p_name", F.lit("  "), "p_brand")).alias("slug"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END, ''), nullif(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END, ''), '') AS first FROM documents")
def first_present(t):
    d = F.col("doc_id")
    return t("documents").select("doc_id", text.first_present(F.when(d % 2 == 0, "").otherwise(F.col("lang")), F.when(d % 3 != 0, F.col("source"))).alias("first"))


_PROGRESS = "CASE event_id % 4 WHEN 0 THEN concat('page ', user_id, '/150 · job ', event_id % 25, '/25') WHEN 1 THEN concat('job ', event_id % 9, ' / 0') WHEN 2 THEN '' ELSE concat('loading ', event_id) END"


@query(f"""SELECT event_id, CASE WHEN b > 0 THEN least(100.0, a / b * 100) END AS percent, CASE WHEN b > 0 THEN false WHEN s <> '' THEN true END AS moving
FROM (SELECT event_id, s, TRY_CAST(regexp_extract(f, '^(\\d+)', 1) AS DOUBLE) AS a, TRY_CAST(regexp_extract(f, '(\\d+)$', 1) AS DOUBLE) AS b
FROM (SELECT event_id, s, regexp_extract_all(s, '\\d+\\s*/\\s*\\d+')[-1] AS f FROM (SELECT event_id, {_PROGRESS} AS s FROM events)))""")
def progress(t):
    return t("events").select("event_id", text.progress(F.expr(_PROGRESS)).alias("p")).select("event_id", "p.percent", "p.moving")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d-%H-%M') AS stamp FROM orders")
def minute_stamp(t):
    return t("orders").select("o_orderkey", text.minute_stamp(F.col("o_orderdate")).alias("stamp"))


@query("""SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN 'error: lost' WHEN event_id % 5 = 1 THEN concat('stopped at ', user_id, '/25 · +', event_id % 7, ' new kept')
WHEN event_id % 5 = 2 THEN 'stopped at 0/0 · +0 new kept' ELSE concat('+', event_id % 7, ' new (', user_id, ' total)') END AS outcome,
CASE WHEN event_id % 3 = 0 THEN 'pipeline offline — not recorded' WHEN event_id % 3 = 1 THEN concat('marked applied · ', user_id, ' total · ', event_id % 7, ' still ranked') ELSE 'already on the applied list' END AS marked,
concat('pipeline up · ', event_id % 7, ' today · ', user_id, ' applied', CASE WHEN event_id % 2 = 0 THEN concat(' · ', event_id % 4, ' ranked') ELSE '' END) AS status FROM events""")
def outcome_texts(t):
    e, u = F.col("event_id"), F.col("user_id")
    known = e % 5 != 2
    return t("events").select(
        "user_id", "event_id",
        text.run_text(F.when(e % 5 == 0, "lost"), e % 5 < 3, F.when(known, u), F.when(known, 25), F.when(known, e % 7), u).alias("outcome"),
        text.applied_text(e % 3 != 0, F.when(e % 3 == 1, 1), u, e % 7).alias("marked"), text.status_text(e % 7, u, F.when(e % 2 == 0, e % 4)).alias("status"),
    )


@query("""SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END, ''), '(unnamed)') AS company,
coalesce(nullif(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END, ''), nullif(CASE WHEN c_custkey % 8 = 0 THEN '' ELSE 'u' END, ''), 'open a job to mark it applied') AS job FROM customer""")
def fallback_labels(t):
    k = F.col("c_custkey")
    name, url = F.when(k % 4 == 0, "").otherwise(F.col("c_name")), F.when(k % 8 == 0, "").otherwise("u")
    return t("customer").select("c_custkey", text.unnamed(name).alias("company"), text.job_label(name, url).alias("job"))


# Addresses of the known sites.
_SITE_URL = """CASE p_partkey % 12 WHEN 0 THEN concat('https://de.indeed.com/jobs?q=data+', p_size, '&vjk=', p_partkey) WHEN 1 THEN concat('https://www.linkedin.com/jobs/view/', p_partkey, '/?x=1')
WHEN 2 THEN concat('https://www.linkedin.com/jobs/search/?keywords=ml%20ops&currentJobId=', p_partkey) WHEN 3 THEN concat('https://www.stepstone.de/jobs/data-science/in-berlin?p=', p_size)
WHEN 4 THEN concat('https://www.stepstone.de/stellenangebote--x-', p_partkey, '.html?a=1') WHEN 5 THEN concat('https://de.indeed.com/viewjob?jk=', p_partkey) WHEN 6 THEN 'https://de.indeed.com/q-data-jobs.html'
WHEN 7 THEN 'https://www.linkedin.com/feed/' WHEN 8 THEN 'https://www.stepstone.de/work/data' WHEN 9 THEN 'https://notindeed.com.example/jobs/x' WHEN 10 THEN NULL ELSE 'https://example.org/' END"""


@query(f"""SELECT p_partkey, CASE WHEN regexp_matches(h, 'indeed\\.com') THEN 'indeed' WHEN regexp_matches(h, 'linkedin\\.com') THEN 'linkedin' WHEN regexp_matches(h, 'stepstone\\.de') THEN 'stepstone' END AS site,
coalesce(u LIKE 'https://%.indeed.com/jobs%' OR u LIKE 'https://%.indeed.com/q-%' OR u LIKE 'https://%.indeed.com/viewjob%' OR u LIKE 'https://www.linkedin.com/jobs/%'
OR u LIKE 'https://www.stepstone.de/jobs/%' OR u LIKE 'https://www.stepstone.de/work/%' OR u LIKE 'https://www.stepstone.de/stellenangebote%', false) AS eligible,
CASE p_partkey % 12 WHEN 0 THEN concat('data ', p_size) WHEN 2 THEN 'ml ops' WHEN 3 THEN 'data science' WHEN 1 THEN 'view' ELSE '' END AS query,
CASE p_partkey % 12 WHEN 0 THEN concat('https://de.indeed.com/viewjob?jk=', p_partkey) WHEN 1 THEN concat('https://www.linkedin.com/jobs/view/', p_partkey, '/') WHEN 2 THEN concat('https://www.linkedin.com/jobs/view/', p_partkey, '/')
WHEN 4 THEN concat('https://www.stepstone.de/stellenangebote--x-', p_partkey, '.html') WHEN 5 THEN u WHEN 6 THEN u WHEN 9 THEN u END AS current
FROM (SELECT *, regexp_extract(u, '://([^/?#]+)', 1) AS h FROM (SELECT p_partkey, p_size, {_SITE_URL} AS u FROM part))""")
def site_addresses(t):
    u = F.col("u")
    return t("part").select("p_partkey", F.expr(_SITE_URL).alias("u")).select(
        "p_partkey", keys.site(u).alias("site"), keys.eligible(u).alias("eligible"), keys.search_query(u).alias("query"), keys.current_job(u).alias("current")
    )


@query("""SELECT page_id, CASE WHEN starts_with(h, '/') THEN concat('https://o.example', h) ELSE h END AS whole, split_part(url, '?', 1) AS bare
FROM (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN '/a/b' WHEN 1 THEN '//host/x' ELSE url END AS h FROM pages)""")
def address_parts(t):
    h = F.when(F.col("page_id") % 3 == 0, "/a/b").when(F.col("page_id") % 3 == 1, "//host/x").otherwise(F.col("url"))
    return t("pages").select("page_id", keys.absolute(h, F.lit("https://o.example")).alias("whole"), keys.without_query(F.col("url")).alias("bare"))


@query("""SELECT page_id, concat(lower(split_part(url, '?', 1)), CASE WHEN regexp_extract(url, '[?&]page=([^&#]+)', 1) <> '' THEN concat('?page=', regexp_extract(url, '[?&]page=([^&#]+)', 1)) ELSE '' END) AS key FROM pages""")
def identity_key(t):
    return t("pages").select("page_id", keys.store_key(F.col("url"), ["page"]).alias("key"))


_FORM = "replace(replace(replace(url_encode({0}), '%20', '+'), '~', '%7E'), '%2A', '*')"
_PART = "replace(replace(replace(replace(replace(url_encode({0}), '%2A', '*'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')')"
_SEARCH = """SELECT n_nationkey AS k, n_name, concat(' ', n_name, ' Ops & C++ (~m*) ') AS kw, CASE WHEN n_nationkey % 3 = 0 THEN ' ' ELSE concat(n_name, ' am Main') END AS loc, n_nationkey % 5 * 10 AS radius,
n_nationkey % 4 AS posted, n_nationkey % 2 = 0 AS remote FROM nation"""


def _search(t):
    k = F.col("n_nationkey")
    return t("nation").select(
        k.alias("k"), F.concat(F.lit(" "), "n_name", F.lit(" Ops & C++ (~m*) ")).alias("kw"), F.when(k % 3 == 0, " ").otherwise(F.concat("n_name", F.lit(" am Main"))).alias("loc"),
        (k % 5 * 10).alias("radius"), (k % 4).alias("posted"), (k % 2 == 0).alias("remote"),
    )


_SLUG = _PART.format("regexp_replace(lower(trim(kw)), '\\s+', '-', 'g')")
_PLACE = _PART.format("lower(trim(loc))")
_STEP = f"""concat('https://www.stepstone.de/jobs/', {_SLUG}, CASE WHEN trim(loc) <> '' THEN concat('/in-', {_PLACE}) ELSE '' END,
CASE WHEN q <> '' THEN concat('?', q) ELSE '' END)"""


@query(f"""SELECT k, {_STEP} AS stepstone,
concat('https://www.linkedin.com/jobs/search/?keywords=', {_FORM.format("trim(kw)")}, CASE WHEN trim(loc) <> '' THEN concat('&location=', {_FORM.format("trim(loc)")}) ELSE '' END,
CASE WHEN radius > 0 THEN concat('&distance=', CAST(round(radius * 0.621371) AS INT)) ELSE '' END, CASE WHEN posted > 0 THEN concat('&f_TPR=r', posted * 86400) ELSE '' END, CASE WHEN remote THEN '&f_WT=2' ELSE '' END) AS linkedin,
concat('https://de.indeed.com/jobs?q=', {_FORM.format("trim(kw)")}, CASE WHEN trim(loc) <> '' THEN concat('&l=', {_FORM.format("trim(loc)")}) ELSE '' END,
CASE WHEN radius > 0 THEN concat('&radius=', radius) ELSE '' END, CASE WHEN posted > 0 THEN concat('&fromage=', posted) ELSE '' END, CASE WHEN remote THEN '&sc=0kf%3Aattr%28DSQF7%29%3B' ELSE '' END) AS indeed
FROM (SELECT *, concat_ws('&', CASE WHEN radius > 0 AND trim(loc) <> '' THEN concat('radius=', radius) END, CASE WHEN posted > 0 THEN concat('ag=', posted * 86400) END, CASE WHEN remote THEN 'wfh=1' END) AS q FROM ({_SEARCH}))""")
def search_urls(t):
    args = [F.col(c) for c in ("kw", "loc", "radius", "posted", "remote")]
    return _search(t).select("k", *[searchurl.search_url(F.lit(s), *args).alias(s) for s in ("stepstone", "linkedin", "indeed")])


@query("SELECT p_partkey, CAST(greatest(1, least(15, coalesce(nullif(n, 0), 3))) AS INT) AS pages, CAST(round(p_size * 0.621371) AS INT) AS miles, CAST(p_size * 86400 AS INT) AS seconds FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size - 10 END AS n FROM part)")
def search_numbers(t):
    n = F.when(F.col("p_partkey") % 6 != 0, F.col("p_size") - 10)
    return t("part").select("p_partkey", searchurl.pages(n).cast("int").alias("pages"), searchurl.miles(F.col("p_size")).alias("miles"), searchurl.seconds(F.col("p_size")).cast("int").alias("seconds"))


# Runs.
@query("""SELECT event_id, coalesce(s > 0 AND n - s <= 1200000, false) AND r > 0 AS resumable, 5 - r + 1 AS page_no FROM (SELECT event_id, epoch_ms(ts) AS n,
CASE WHEN event_id % 10 = 0 THEN 0 ELSE epoch_ms(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id)) END AS s, event_id % 4 AS r FROM events)""")
def stale_runs(t):
    n = F.unix_millis(F.col("ts").cast("timestamp"))
    before = F.when(F.col("event_id") % 10 == 0, F.lit(0).cast("bigint")).otherwise(F.lag(n).over(Window.partitionBy("user_id").orderBy("event_id")))
    rows = t("events").select("event_id", n.alias("n"), before.alias("s"), (F.col("event_id") % 4).alias("r"))
    return rows.select("event_id", run.resumable(F.col("n"), F.col("s"), F.col("r")).alias("resumable"), run.page_number(F.lit(5), F.col("r")).cast("bigint").alias("page_no"))


@query("""SELECT day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS running FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)""")
def running_new(t):
    days = t("events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return run.running_total(days, "n", "day", [], chunk=F.trunc("day", "month"))


@query("""SELECT user_id, count(*) AS kept FROM (SELECT user_id, event_id, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS stop FROM events)
WHERE stop IS NULL OR event_id < stop GROUP BY user_id""")
def stop_prefix(t):
    kept = run.before_stop(t("events"), F.col("event_type") == "error", "event_id", ["user_id"])
    return kept.groupBy("user_id").agg(F.count("*").alias("kept"))


@query("""SELECT event_id, total - remaining + 1 AS page_no, remaining - 1 AS remaining, collected + added AS collected, remaining - 1 <= 0 OR NOT has_next AS done
FROM (SELECT event_id, 9 AS total, event_id % 9 + 1 AS remaining, user_id AS collected, event_id % 5 AS added, event_id % 3 <> 0 AS has_next FROM events)""")
def run_advance(t):
    e = F.col("event_id")
    state = t("events").select("event_id", F.lit(9).alias("total"), (e % 9 + 1).alias("remaining"), F.col("user_id").alias("collected"), (e % 5).alias("added"), (e % 3 != 0).alias("has_next"))
    return run.advance(state).select("event_id", "page_no", "remaining", "collected", "done")


@query("SELECT event_id, CASE WHEN event_id * 10 - CASE WHEN event_id % 2 = 0 THEN event_id * 10 - event_id % 6000 ELSE 0 END > 3000 THEN 'stored' ELSE 'live' END AS shown FROM events")
def shown_status(t):
    e = F.col("event_id")
    return t("events").select("event_id", run.shown_status(e * 10, F.when(e % 2 == 0, e * 10 - e % 6000), F.lit("stored"), F.lit("live")).alias("shown"))


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, least(count(*) OVER (PARTITION BY user_id ORDER BY event_id), user_id % 7 + 1) AS n FROM events),
m AS (SELECT *, n = lag(n, 1) OVER w AND n = lag(n, 2) OVER w AS stable FROM s WHERE step <= 25 WINDOW w AS (PARTITION BY user_id ORDER BY step))
SELECT m.user_id, CAST(m.step AS BIGINT) AS step, CAST(m.n AS BIGINT) AS n FROM m JOIN (SELECT user_id, coalesce(min(CASE WHEN stable THEN step END), max(step)) AS step FROM m GROUP BY user_id) c ON m.user_id = c.user_id AND m.step = c.step""")
def settled_counts(t):
    steps = t("events").selectExpr("user_id", "CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS step", "least(count(*) OVER (PARTITION BY user_id ORDER BY event_id), user_id % 7 + 1) AS n")
    return collect.settled(steps, "user_id", "step", "n").select("user_id", "step", long(F.col("n")).alias("n"))


# Batches: some forty customers of one segment are a day's batch, and its roles; there are the more batches, the more customers.
_ROLE = """SELECT c_mktsegment AS date, c_custkey AS pos, c_nationkey AS rank, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_name END AS company, concat('T', c_custkey) AS title,
CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'X & Y' END AS location, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('http://j/', c_custkey) END AS url, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'fits' END AS why,
c_custkey % 3 AS n_flags FROM customer"""


_BATCHED = _ROLE.replace("c_mktsegment AS date", "concat(c_mktsegment, ' ', c_custkey // 40) AS date")


def _roles(t):
    k = F.col("c_custkey")
    one = F.array(F.lit("a flag"), F.lit("B"))
    files = F.array(F.struct(F.lit("CV").alias("label"), F.concat(F.lit("out/"), k, F.lit(".pdf")).alias("path")), F.struct(F.lit("none").alias("label"), F.lit("").alias("path")))
    return t("customer").select(
        F.col("c_mktsegment").alias("date"), k.alias("pos"), F.col("c_nationkey").alias("rank"), F.when(k % 9 != 0, F.col("c_name")).alias("company"), F.concat(F.lit("T"), k).alias("title"),
        F.when(k % 4 != 0, "X & Y").alias("location"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("http://j/"), k)).alias("url"), F.when(k % 6 == 0, "").otherwise("fits").alias("why"),
        F.when(k % 3 != 0, F.slice(one, F.lit(1), (k % 3).cast("int"))).alias("flags"), files.alias("files"),
    )


def _batches(t):
    r = _roles(t).withColumn("date", F.concat("date", F.lit(" "), F.expr("pos div 40")))
    role = F.struct("pos", *[F.col(c) for c in ("rank", "company", "title", "location", "url", "why", "flags", "files")])
    gone = F.when(F.col("pos") % 10 == 0, F.struct("pos", "company", "title", F.lit("far").alias("reason")))
    return r.groupBy("date").agg(F.array_sort(F.collect_list(role)).alias("built"), F.array_sort(F.collect_list(gone)).alias("dropped"), (F.count("*") % 2).alias("pool_size")).withColumn("note", F.lit(""))


@query(f"""SELECT date, pos, title, url, url <> '' AS has_url, CASE WHEN why = '' THEN 'no rationale recorded' ELSE why END AS why_text, CAST(n_flags AS INT) AS n_flags, concat('out/', pos, '.pdf') AS file,
lower(concat_ws(' ', title, coalesce(company, 'None'), coalesce(location, 'None'), why, CASE n_flags WHEN 0 THEN '' WHEN 1 THEN 'a flag' ELSE 'a flag B' END)) AS haystack FROM ({_BATCHED})""")
def batch_cards(t):
    c = batch.cards(_batches(t)).withColumn("pos", F.expr("CAST(substring(title, 2) AS BIGINT)"))
    return c.select("date", "pos", "title", "url", "has_url", "why_text", "n_flags", F.col("files")[0]["path"].alias("file"), "haystack")


@query(f"SELECT date, company, title, 'far' AS reason FROM ({_BATCHED}) WHERE pos % 10 = 0")
def batch_dropped(t):
    return batch.dropped(_batches(t)).select("date", "company", "title", "reason")


@query(f"SELECT date, CAST(count(*) AS INT) AS n_built, CAST(count(*) FILTER (WHERE pos % 10 = 0) AS INT) AS n_dropped, nullif(count(*) % 2, 0) AS pool FROM ({_BATCHED}) GROUP BY date")
def batch_sizes(t):
    return batch.sizes(_batches(t))


_RANK = f"SELECT pos, rank, CAST(coalesce(nullif(rank, 0), 99) AS INT) AS rank_key, row_number() OVER (ORDER BY coalesce(nullif(rank, 0), 99), pos) AS place FROM ({_ROLE})"


@query(_RANK)
def rank_sort(t):
    return batch.rank_places(_roles(t), "pos").select("pos", "rank", "rank_key", "place")


@query(f"SELECT pos, rank_key FROM ({_RANK}) WHERE place <= 5")
def top_ranked(t):
    return batch.top(_roles(t), 5, "pos").select("pos", "rank_key")


@query(f"SELECT pos AS key, CAST(coalesce(nullif(rank, 0), 99) AS INT) AS rank_key, coalesce(company, '(unnamed)') AS company FROM ({_ROLE}) WHERE date = 'BUILDING'")
def day_list(t):
    return batch.batch_list(_roles(t).withColumn("key", F.col("pos")), "BUILDING")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'idiot')")
def text_filter(t):
    return batch.matching(t("documents").select("doc_id", F.lower("text").alias("haystack")), " Idiot ").select("doc_id")


@query("""SELECT p.page_id, CASE WHEN b.key IS NULL THEN '' ELSE concat('✓ documents built ', b.date, ' (#', b.rank, ')') END AS flag
FROM pages p LEFT JOIN (SELECT lower(regexp_replace(split_part(url, '?', 1), '/$', '')) AS key, lang AS date, page_id AS rank FROM (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN 'd1' ELSE 'd2' END AS lang FROM pages) WHERE page_id % 3 = 0) b
ON lower(regexp_replace(split_part(p.url, '?', 1), '/$', '')) = b.key""")
def built_flag(t):
    key = keys.lookup_key(F.col("url"))
    built = t("pages").filter("page_id % 3 = 0").select(key.alias("key"), F.when(F.col("page_id") % 2 == 0, "d1").otherwise("d2").alias("date"), F.col("page_id").alias("rank"))
    return batch.built_flag(t("pages"), built, key).select("page_id", text.built_text(F.col("built_date"), F.col("built_rank")).alias("flag"))


_CARD = """concat('<article class="card" data-url="', url, '" data-search="', haystack, '"><span class="rank">', rank, '</span>',
CASE WHEN url <> '' THEN concat('<a class="title" href="', url, '">', title, '</a>') ELSE concat('<span class="title">', title, '</span>') END, '<span class="org">', coalesce(company, ''), ' · ', coalesce(replace(location, '&', '&amp;'), ''),
'</span><p class="why">', CASE WHEN why = '' THEN 'no rationale recorded' ELSE why END, '</p>', CASE n_flags WHEN 0 THEN '' WHEN 1 THEN '<ul class="flags"><li>a flag</li></ul>' ELSE '<ul class="flags"><li>a flag</li><li>B</li></ul>' END,
'<div class="files"><a href="out/', pos, '.pdf" download="', pos, '.pdf">CV</a>', CASE WHEN url <> '' THEN concat('<a href="', url, '">posting</a>') ELSE '' END, '</div></article>')"""
_HAYSTACK = "replace(lower(concat_ws(' ', title, coalesce(company, 'None'), coalesce(location, 'None'), why, CASE n_flags WHEN 0 THEN '' WHEN 1 THEN 'a flag' ELSE 'a flag B' END)), '&', '&amp;')"
_GONE = "concat('<tr><td>', coalesce(company, ''), '</td><td>', title, '</td><td>far</td></tr>')"


@query(f"""SELECT date, md5(concat('<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>Batch ', date, '</title></head><body><h1>Batch ', date, '</h1><p>', n, ' built', CASE WHEN n % 2 = 1 THEN ' from a pool of 1' ELSE '' END, '</p>\n', cards,
CASE WHEN n_gone > 0 THEN concat('<h2>Not built</h2><p>', n_gone, ' considered and left out</p><table>', gone, '</table>') ELSE '' END, '</body></html>\n')) AS html, n AS cards
FROM (SELECT date, count(*) AS n, count(*) FILTER (WHERE pos % 10 = 0) AS n_gone, string_agg({_CARD}, '\n' ORDER BY pos) AS cards, string_agg(CASE WHEN pos % 10 = 0 THEN {_GONE} END, '\n' ORDER BY pos) AS gone
FROM (SELECT *, {_HAYSTACK} AS haystack FROM ({_BATCHED})) GROUP BY date)""")
def batch_report(t):
    pages = batch.report(_batches(t))
    return pages.select("date", F.md5("html").alias("html"), long(F.size(F.split("html", '<article class="card"', -1)) - 1).alias("cards"))


# Layouts and files.
@query(f"""SELECT path, row_number() OVER (PARTITION BY path ORDER BY k, i) - 1 AS ord, style, text FROM (
SELECT CAST(c AS VARCHAR) AS path, k, unnest(range(0, CASE type WHEN 'skills' THEN 2 ELSE 6 END)) AS i, unnest(CASE type WHEN 'skills' THEN ['section', 'rule'] ELSE ['section', 'rule', 'role', 'meta', 'bullet', 'bullet'] END) AS style,
unnest(CASE type WHEN 'skills' THEN [concat('TITLE ', k), ''] ELSE [concat('TITLE ', k), '', 'r', 'm', concat('<b>A:</b> ', k), concat('b ', k)] END) AS text FROM ({_CV})
UNION ALL SELECT DISTINCT CAST(o_custkey AS VARCHAR), -1, unnest([0, 1]), unnest(['name', 'rule']), unnest(['N', '']) FROM orders)""")
def cv_layout(t):
    section = F.transform("sections", lambda s: F.struct(s["type"].alias("type"), s["title"].alias("title"), F.when(s["type"] != "skills", s["items"]).alias("items"), F.lit(None).cast("array<struct<label:string,value:string>>").alias("skills")))
    cvs = _cvs(t).select("path", F.lit("N").alias("name"), F.lit("").alias("tagline"), F.array().cast("array<string>").alias("contact"), F.lit(None).cast("string").alias("summary"), section.alias("sections"))
    return layout.cv(cvs).select("path", long(F.col("ord")).alias("ord"), "style", "text")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS path, unnest(range(0, 11)) AS ord, unnest(['name', 'meta', 'meta', 'meta', 'subject', 'body', 'body', 'body', 'body', 'body', 'body']) AS style,
unnest([s_name, 'street', 'Company', 'a date', 'subject', 'Dear', 'p1', 'p2', 'p3', 'Bye', s_name]) AS text FROM supplier""")
def letter_layout(t):
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    letters = t("supplier").select(
        F.col("s_suppkey").cast("string").alias("path"), F.array(F.col("s_name"), F.lit("street")).alias("sender"), F.lit("a date").alias("date"), lit("Company").alias("recipient"),
        F.lit("subject").alias("subject"), F.lit("Dear").alias("salutation"), lit("p1", "p2", "p3").alias("paragraphs"), F.lit("Bye").alias("closing"), F.col("s_name").alias("signature"),
    )
    return layout.letter(letters).withColumn("ord", long(F.col("ord")))


@query("SELECT o_orderkey, CASE WHEN n < 8192 THEN 8258 ELSE n END AS size FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 20000 AS n FROM orders)")
def finished_size(t):
    n = F.floor("o_totalprice").cast("bigint") % 20000
    return t("orders").select("o_orderkey", long(layout.finished_size(n)).alias("size"))


@query("SELECT p_partkey, concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(', ', p_brand) END) AS heading, concat('<b>', p_brand, ':</b> ', p_type) AS skill, upper(p_type) AS section FROM part")
def layout_texts(t):
    org = F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand"))
    return t("part").select("p_partkey", layout.heading(F.col("p_name"), org).alias("heading"), layout.skill(F.col("p_brand"), F.col("p_type")).alias("skill"), F.upper("p_type").alias("section"))


# Whole texts: one candidate in three is empty, one has newlines in rows and white space at its ends.
@query("""SELECT doc_id, md5(CASE WHEN len(a) > 300 THEN regexp_replace(a, '\\n{3,}', chr(10) || chr(10), 'g') WHEN len(text) > 300 THEN regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g') ELSE '' END) AS detail,
len(a) AS pane, len(a) > 200 AS ready FROM (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN text ELSE concat(text, repeat(chr(10), 4), text) END AS a FROM documents)""")
def detail_pick(t):
    k = F.col("doc_id") % 3
    gap = F.lit("\n\n\n\n")
    rows = t("documents").select("doc_id", F.when(k == 0, "").when(k == 1, F.col("text")).otherwise(F.concat(gap, "text", gap, "text", F.lit(" \t"))).alias("a"), F.col("text").alias("b"))
    return rows.select(
        "doc_id", F.md5(collect.detail_text(F.col("a"), F.col("b"))).alias("detail"), long(F.length(collect.pane_text(F.col("a")))).alias("pane"), collect.pane_ready(F.col("a")).alias("ready")
    )


# Captured pages of the three sites, made from parts.
_INDEED = """concat('<html><body><div class="job_seen_beacon"><h2 class="jobTitle"><a data-jk="', p_partkey, '" href="', CASE WHEN p_partkey % 2 = 0 THEN concat('/rc/clk?jk=', p_partkey) ELSE '' END, '"></a>', p_name,
'</h2><span data-testid="company-name">', p_brand, ' &amp; Co</span></div><div class="job_seen_beacon">no link</div></body></html>')"""
_LINKED = """concat('<ul><li data-occludable-job-id="', p_partkey, '"><div class="job-card-container x"><a class="job-card-list__title" href="/jobs/view/', p_partkey, '/?trk=1"><span>', p_name, '</span> <span>', p_name,
'</span> with verification</a><div class="artdeco-entity-lockup__subtitle">', p_brand, '</div></div></li></ul>')"""
_STEPPED = """concat('<article data-at="job-item"><a href="/stellenangebote--x-', p_partkey, '">', p_name, '</a><span data-at="job-item-company-name">', p_brand, '</span><span data-at="job-item-location">', p_type, '</span></article>')"""


@query("""SELECT p_partkey, p_name AS title, CASE p_partkey % 3 WHEN 0 THEN concat(p_brand, ' & Co') ELSE p_brand END AS company, CASE p_partkey % 3 WHEN 2 THEN p_type ELSE '' END AS location,
CASE p_partkey % 3 WHEN 0 THEN concat('https://de.indeed.com', CASE WHEN p_partkey % 2 = 0 THEN '/rc/clk?jk=' ELSE '/viewjob?jk=' END, p_partkey) WHEN 1 THEN concat('https://www.linkedin.com/jobs/view/', p_partkey, '/')
ELSE concat('https://www.stepstone.de/stellenangebote--x-', p_partkey) END AS url, CASE p_partkey % 3 WHEN 0 THEN 'Indeed' WHEN 1 THEN 'LinkedIn' ELSE 'StepStone' END AS source,
CASE p_partkey % 3 WHEN 0 THEN 'a b' WHEN 1 THEN 'ml' ELSE 'data eng' END AS query FROM part""")
def scan_cards(t):
    k = F.col("p_partkey") % 3
    url = F.when(k == 0, "https://de.indeed.com/jobs?q=a+b").when(k == 1, "https://www.linkedin.com/jobs/search/?keywords=ml").otherwise("https://www.stepstone.de/jobs/data-eng/in-x")
    page = F.when(k == 0, F.expr(_INDEED)).when(k == 1, F.expr(_LINKED)).otherwise(F.expr(_STEPPED))
    cards = html.scan_cards(spread(t("part"), "p_partkey").select("p_partkey", url.alias("url"), page.alias("html")))
    return collect.collect_cards(cards, ["p_partkey"]).select("p_partkey", "title", "company", "location", "url", "source", "query")


_CLEAN = "replace(replace(text, '<', ' '), '&', ' ')"
_LINES = rf"regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '[ \t\r\f]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"


# The whole text is in the last candidate; the first is too short on all pages, the second on two in three.
@query(rf"""SELECT doc_id, CAST(len(d) AS BIGINT) AS n, md5(d) AS description FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('second ', repeat('x', 300)) WHEN len(x) > 300 THEN x ELSE '' END AS d
FROM (SELECT doc_id, regexp_replace({_LINES}, '^\s+|\s+$', '', 'g') AS x FROM documents))""")
def scan_details(t):
    second = "CASE WHEN doc_id % 3 = 0 THEN repeat('x', 300) ELSE '' END"
    page = F.expr(f"concat('<html><head><style>p</style></head><body><script>x()</script><div data-at=\"job-ad-content\">first ', doc_id, '</div><p class=\"a job-ad-display\">second ', {second}, '</p><main>', {_CLEAN}, '</main></body></html>')")
    rows = t("documents").select("doc_id", F.lit("https://www.stepstone.de/stellenangebote--x").alias("url"), page.alias("html"))
    return html.scan_details(rows).select("doc_id", long(F.length("description")).alias("n"), F.md5("description").alias("description"))


@query(rf"""SELECT doc_id, CAST(len(d) AS BIGINT) AS n, md5(d) AS description
FROM (SELECT doc_id, CASE WHEN len(x) > 300 THEN x ELSE '' END AS d FROM (SELECT doc_id, regexp_replace({_LINES}, '^\s+|\s+$', '', 'g') AS x FROM documents))""")
def scan_details_whole(t):
    page = F.expr(f"concat('<html><head><style>p</style></head><body><script>x()</script><main>', {_CLEAN}, '</main></body></html>')")
    rows = t("documents").select("doc_id", F.lit("https://www.stepstone.de/stellenangebote--x").alias("url"), page.alias("html"))
    return html.scan_details(rows).select("doc_id", long(F.length("description")).alias("n"), F.md5("description").alias("description"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected postings of all pages, upserted into an empty store."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    cards = pages.select(
        F.lit(1).alias("page_no"), F.col("page_id").alias("pos"), F.concat(F.lit("page "), F.col("page_id")).alias("title"), F.regexp_extract("url", "://([^/?#]+)", 1).alias("company"), F.lit("").alias("location"), "url"
    )
    postings = collect.with_constants(collect.collect_cards(cards), F.lit("pages"), F.lit("")).withColumn("seq", F.col("pos"))
    return store.latest(postings, keys.store_key(F.col("url")))
