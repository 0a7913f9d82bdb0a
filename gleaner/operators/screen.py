"""Judging postings by their text: relevance, demanded languages, years of experience, blockers and flags, and an audit of it.

All rules are lexical and told with what made them speak, so that a reader can check each verdict. Word lists are parameters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import present, strip

LANGUAGES = ("german", "deutsch")
DEMANDS = ("required", "must", "fluent", "native", "mandatory", "erforderlich", "verhandlungssicher", "c1", "c2")
OPTIONAL = ("a plus", "nice to have", "optional", "advantage", "von vorteil", "not required")
#: Rules by name: a posting with one of these patterns is blocked, or flagged.
BLOCKERS = {"unpaid": r"(?i)\b(unpaid|unbezahlt)\b", "too_senior": r"(?i)\b(head of|vice president|director)\b"}
FLAGS = {"senior": r"(?i)\bsenior\b", "on_call": r"(?i)\bon-call\b"}
MOST_YEARS = 7


def sentences(text: Column) -> Column:
    """Trimmed sentences: what full stops, marks and line ends part; empty ones don't count."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+", -1), strip)
    return F.filter(parts, lambda s: s != "")


def relevance(title: Column, description: Column, weights: Mapping[str, float], title_times: int = 2) -> Column:
    """Sum of the weights of the keywords that are in the description, and title_times those in the title; lower case."""
    t, d = (F.lower(F.coalesce(c, F.lit(""))) for c in (title, description))
    total = F.lit(0.0)
    for word, w in weights.items():
        total = total + F.when(F.contains(d, F.lit(word)), w).otherwise(0.0) + F.when(F.contains(t, F.lit(word)), w * title_times).otherwise(0.0)
    return total


def above_floor(scored: DataFrame, floor: float, score: str = "score") -> DataFrame:
    return scored.filter(F.col(score) >= floor)


def _any(words: Sequence[str]) -> str:
    return rf"(?i)\b({'|'.join(words)})\b"


def language_evidence(text: Column, languages: Sequence[str] = LANGUAGES, demands: Sequence[str] = DEMANDS, optional: Sequence[str] = OPTIONAL) -> Column:
    """The first sentence that demands one of the languages: it names the language and a demand, and no word that makes it optional. Null if there is none."""
    demanding = lambda s: s.rlike(_any(languages)) & s.rlike(_any(demands)) & ~s.rlike(_any(optional))
    return F.get(F.filter(sentences(text), demanding), F.lit(0))


def years(text: Column) -> Column:
    """The most years of experience that are named, as in `3+ years` or `5 Jahre`; null if none are."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\b([0-9]{1,2})\+? *(?:years?|jahre)\b"), F.lit(1))
    return F.array_max(F.transform(found, lambda x: x.cast("int")))


def fired(text: Column, rules: Mapping[str, str]) -> Column:
    """Names of the rules whose pattern is in the text, in the order of the rules."""
    t = F.coalesce(text, F.lit(""))
    return F.filter(F.array(*[F.when(t.rlike(p), F.lit(k)) for k, p in rules.items()]), lambda k: k.isNotNull())


def screen(postings: DataFrame, weights: Mapping[str, float], floor: float, blockers: Mapping[str, str] = BLOCKERS, flags: Mapping[str, str] = FLAGS, most_years: int = MOST_YEARS) -> DataFrame:
    """postings (title, description, other columns) with score, evidence, years, blockers, flags and verdict.

    The verdict is the first that holds of language, years, blocked (by rules) and off_profile (a score under the floor); else passed. A
    language that is an advantage blocks nothing. No shuffle; null texts are empty."""
    d = F.col("description")
    rows = postings.withColumns({
        "score": relevance(F.col("title"), d, weights), "evidence": language_evidence(d), "years": years(d),
        "blockers": fired(F.concat_ws(" ", "title", "description"), blockers), "flags": fired(F.concat_ws(" ", "title", "description"), flags),
    })
    verdict = (
        F.when(F.col("evidence").isNotNull(), "language").when(F.coalesce(F.col("years") > most_years, F.lit(False)), "years")
        .when(F.size("blockers") > 0, "blocked").when(F.col("score") < floor, "off_profile").otherwise("passed")
    )
    return rows.withColumn("verdict", verdict)


def audit_line(ident: Column, excerpt: int = 80) -> Column:
    """One line for a row of screen(): a rejected posting with the sentence or rule that condemned it, a passed one with the beginning of its first sentence."""
    why = (
        F.when(F.col("verdict") == "language", F.col("evidence")).when(F.col("verdict") == "years", F.concat(F.col("years").cast("string"), F.lit(" years")))
        .when(F.col("verdict") == "blocked", F.array_join("blockers", ", ")).when(F.col("verdict") == "off_profile", F.lit("score under the floor"))
        .otherwise(F.left(F.coalesce(F.get(sentences(F.col("description")), F.lit(0)), F.lit("")), F.lit(excerpt)))
    )
    return F.concat_ws(" | ", ident.cast("string"), "verdict", present(F.array_join("flags", ", ")), F.regexp_replace(why, r"\s+", " "))
