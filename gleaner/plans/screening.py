"""Queries that judge postings by their text. Documents stand in for descriptions, with a sentence of demands added to most."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import screen, store
from gleaner.plans.registry import long, query

_POST = """concat(text, CASE doc_id % 7 WHEN 0 THEN '. Fluent German is required! Thanks' WHEN 1 THEN '. Fluent German is a plus. At least 5 years of it' WHEN 2 THEN '. 3+ years, better 12 Jahre' WHEN 3 THEN
'. An unpaid role, senior and on-call. German must be learnt? 2 years' WHEN 4 THEN '. Must know German' ELSE '' END)"""
_WEIGHTS = {"tion": 2.0, "sch": 3.0, "des": 1.0, "qzx": 9.0}
_FLOOR = 3.0
_SENTENCES = r"[s FOR s IN [regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split_regex(d, '[.!?\n]+')] IF s <> '']"
_LANGUAGE, _DEMAND, _OPTIONAL = (screen._any(w) for w in (screen.LANGUAGES, screen.DEMANDS, screen.OPTIONAL))
_DEMANDING = f"[s FOR s IN ss IF regexp_matches(s, '{_LANGUAGE}') AND regexp_matches(s, '{_DEMAND}') AND NOT regexp_matches(s, '{_OPTIONAL}')]"
_SCORE = " + ".join(f"CASE WHEN contains(lower(d), '{w}') THEN {x} ELSE 0 END + CASE WHEN contains(lower(source), '{w}') THEN {2 * x} ELSE 0 END" for w, x in _WEIGHTS.items())
_BASE = f"""SELECT doc_id, source, d, ss, {_DEMANDING}[1] AS evidence, CAST({_SCORE} AS DOUBLE) AS score,
list_max([CAST(x AS BIGINT) FOR x IN regexp_extract_all(d, '(?i)\\b([0-9]{{1,2}})\\+? *(?:years?|jahre)\\b', 1)]) AS years,
CASE WHEN regexp_matches(d, '{screen.BLOCKERS["unpaid"]}') THEN 'unpaid' ELSE '' END AS b1, CASE WHEN regexp_matches(d, '{screen.BLOCKERS["too_senior"]}') THEN 'too_senior' ELSE '' END AS b2,
CASE WHEN regexp_matches(d, '{screen.FLAGS["senior"]}') THEN 'senior' ELSE '' END AS f1, CASE WHEN regexp_matches(d, '{screen.FLAGS["on_call"]}') THEN 'on_call' ELSE '' END AS f2
FROM (SELECT doc_id, source, d, {_SENTENCES} AS ss FROM (SELECT doc_id, coalesce(source, '') AS source, coalesce({_POST}, '') AS d FROM documents))"""
_JOINED = "CASE WHEN {0}1 <> '' AND {0}2 <> '' THEN concat({0}1, ', ', {0}2) ELSE concat({0}1, {0}2) END"
_JUDGED = f"""SELECT *, {_JOINED.format('b')} AS blockers, {_JOINED.format('f')} AS flags,
CASE WHEN evidence IS NOT NULL THEN 'language' WHEN coalesce(years, 0) > {screen.MOST_YEARS} THEN 'years' WHEN b1 <> '' OR b2 <> '' THEN 'blocked' WHEN score < {_FLOOR} THEN 'off_profile' ELSE 'passed' END AS verdict FROM ({_BASE})"""


def _screened(t):
    rows = t("documents").select("doc_id", F.coalesce("source", F.lit("")).alias("title"), F.expr(_POST).alias("description"))
    return screen.screen(rows, _WEIGHTS, _FLOOR)


@query(f"SELECT doc_id, score FROM ({_BASE})")
def relevance_score(t):
    return t("documents").select("doc_id", screen.relevance(F.col("source"), F.expr(_POST), _WEIGHTS).alias("score"))


@query(f"SELECT doc_id, score FROM ({_BASE}) WHERE score >= {_FLOOR}")
def relevance_floor(t):
    return screen.above_floor(_screened(t), _FLOOR).select("doc_id", "score")


@query(f"SELECT doc_id, evidence IS NULL AS ok, evidence FROM ({_BASE})")
def language_gate(t):
    evidence = screen.language_evidence(F.expr(_POST))
    return t("documents").select("doc_id", evidence.isNull().alias("ok"), evidence.alias("evidence"))


@query(f"SELECT doc_id, years FROM ({_BASE})")
def years_named(t):
    return t("documents").select("doc_id", long(screen.years(F.expr(_POST))).alias("years"))


@query(f"SELECT doc_id, blockers, flags, verdict FROM ({_JUDGED})")
def blockers_and_flags(t):
    return _screened(t).select("doc_id", F.array_join("blockers", ", ").alias("blockers"), F.array_join("flags", ", ").alias("flags"), "verdict")


@query(rf"""SELECT doc_id, concat(doc_id, ' | ', verdict, CASE WHEN flags <> '' THEN concat(' | ', flags) ELSE '' END, ' | ', regexp_replace(
CASE verdict WHEN 'language' THEN evidence WHEN 'years' THEN concat(years, ' years') WHEN 'blocked' THEN blockers WHEN 'off_profile' THEN 'score under the floor' ELSE left(coalesce(ss[1], ''), 80) END, '\s+', ' ', 'g')) AS line
FROM ({_JUDGED})""")
def audit_lines(t):
    return _screened(t).select("doc_id", screen.audit_line(F.col("doc_id")).alias("line"))


@query(f"SELECT doc_id, score FROM ({_JUDGED}) j WHERE verdict = 'passed' AND NOT EXISTS (SELECT 1 FROM labels a WHERE a.doc_id = j.doc_id)")
def shortlist(t):
    return store.not_applied(_screened(t).filter("verdict = 'passed'"), t("labels"), ["doc_id"]).select("doc_id", "score")
