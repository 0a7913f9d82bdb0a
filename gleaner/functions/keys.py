"""Keys and parts of posting addresses.

Four keys differ in what they do with closing slashes, on purpose: rows that one
page repeats, rows in the store, rows looked up among built ones, and rows with marks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import present

# Host patterns of the known sites (unanchored), and the pages where collecting is offered.
SITES = (("indeed", "Indeed", "indeed\\.com"), ("linkedin", "LinkedIn", "linkedin\\.com"), ("stepstone", "StepStone", "stepstone\\.de"))
ELIGIBLE = (
    "https://%.indeed.com/jobs%",
    "https://%.indeed.com/q-%",
    "https://%.indeed.com/viewjob%",
    "https://www.linkedin.com/jobs/%",
    "https://www.stepstone.de/jobs/%",
    "https://www.stepstone.de/work/%",
    "https://www.stepstone.de/stellenangebote%",
)


def without_query(url: Column) -> Column:
    return F.split_part(url, F.lit("?"), F.lit(1))


def _path(url: Column, identity: Sequence[str]) -> Column:
    """The address up to its query; with the named parameters, if any, kept in their order."""
    base = without_query(F.coalesce(url, F.lit("")))
    if not identity:
        return base
    kept = [F.concat(F.lit(f"{name}="), present(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)))) for name in identity]
    return F.concat(base, F.coalesce(F.concat(F.lit("?"), present(F.concat_ws("&", *kept))), F.lit("")))


def store_key(url: Column, identity: Sequence[str] = ()) -> Column:
    """Closing slashes stay. identity: parameters that tell postings apart on sites whose ids are in the query (off by default)."""
    return F.lower(_path(url, identity))


def page_key(url: Column, identity: Sequence[str] = ()) -> Column:
    """All closing slashes go."""
    return F.lower(F.regexp_replace(_path(url, identity), "/+\\z", ""))


def lookup_key(url: Column) -> Column:
    """One closing slash goes."""
    return F.lower(F.regexp_replace(without_query(F.coalesce(url, F.lit(""))), "/\\z", ""))


def mark_key(url: Column) -> Column:
    return F.coalesce(url, F.lit(""))


def host(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def origin(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def parameter(url: Column, name: str) -> Column:
    """A query parameter, decoded; null if absent."""
    return present(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(name))))


def absolute(href: Column, page_origin: Column) -> Column:
    return F.when(F.startswith(href, F.lit("/")), F.concat(page_origin, href)).otherwise(href)


def site(url: Column) -> Column:
    """The first known site whose host pattern fits; else null."""
    h = host(url)
    out = F.when(F.lit(False), F.lit(""))
    for name, _, pattern in SITES:
        out = out.when(h.rlike(pattern), F.lit(name))
    return out


def site_label(name: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for key, label, _ in SITES:
        out = out.when(name == key, F.lit(label))
    return out


def eligible(url: Column) -> Column:
    out = F.lit(False)
    for pattern in ELIGIBLE:
        out = out | url.like(pattern)
    return F.coalesce(out, F.lit(False))


def search_query(url: Column) -> Column:
    """What a list page was searched for: parameter q, else keywords, else the path's part after /jobs/ if a slash follows it."""
    part = F.replace(F.regexp_extract(path(url), "/jobs/([^/]+)/", 1), F.lit("-"), F.lit(" "))
    return F.coalesce(parameter(url, "q"), parameter(url, "keywords"), part)


def current_job(url: Column) -> Column:
    """The address of the posting that a page shows; null where it shows none."""
    number = F.coalesce(present(F.regexp_extract(path(url), "/jobs/view/(\\d+)", 1)), parameter(url, "currentJobId"))
    code = F.coalesce(parameter(url, "vjk"), parameter(url, "jk"))
    which = site(url)
    return (
        F.when(which == "linkedin", F.concat(F.lit("https://www.linkedin.com/jobs/view/"), number, F.lit("/")))
        .when(which == "indeed", F.coalesce(F.concat(origin(url), F.lit("/viewjob?jk="), code), url))
        .when((which == "stepstone") & F.contains(path(url), F.lit("stellenangebote")), without_query(url))
    )
