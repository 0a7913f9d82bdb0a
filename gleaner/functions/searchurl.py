"""Search addresses of the known sites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import present, slug, strip

# Fixed values.
MILES_IN_KM = 0.621371
DAY = 86400
REMOTE_ATTRIBUTE = "0kf:attr(DSQF7);"


def form_encoded(c: Column) -> Column:
    """A value of a query: blanks become plus signs."""
    return F.url_encode(c)


def path_encoded(c: Column) -> Column:
    """A part of a path: blanks become %20, and ! ' ( ) ~ stay."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for plain, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def miles(km: Column) -> Column:
    return F.round(km * MILES_IN_KM).cast("int")


def seconds(days: Column) -> Column:
    return days * DAY


def _pair(name: str, value: Column) -> Column:
    """name=value, or null if the value is null."""
    return F.concat(F.lit(f"{name}="), value)


def _number(c: Column) -> Column:
    """As text; null and 0 are absent."""
    return F.nullif(c, F.lit(0)).cast("string")


def _query(*pairs: Column) -> Column:
    return F.concat_ws("&", *pairs)


def stepstone(kw: Column, loc: Column, radius: Column, posted: Column, remote: Column) -> Column:
    """Radius only with a location; days become seconds."""
    place = present(F.lower(strip(F.coalesce(loc, F.lit("")))))
    base = F.concat(F.lit("https://www.stepstone.de/jobs/"), path_encoded(slug(kw)), F.coalesce(F.concat(F.lit("/in-"), path_encoded(place)), F.lit("")))
    q = _query(
        _pair("radius", F.when(place.isNotNull(), _number(radius))), _pair("ag", _number(seconds(posted))), _pair("wfh", F.when(remote, F.lit("1")))
    )
    return F.concat(base, F.coalesce(F.concat(F.lit("?"), present(q)), F.lit("")))


def linkedin(kw: Column, loc: Column, radius: Column, posted: Column, remote: Column) -> Column:
    """Radius in miles, with or without a location."""
    q = _query(
        _pair("keywords", form_encoded(strip(kw))), _pair("location", form_encoded(present(strip(loc)))),
        _pair("distance", F.when(F.nullif(radius, F.lit(0)).isNotNull(), miles(radius).cast("string"))),
        _pair("f_TPR", F.concat(F.lit("r"), _number(seconds(posted)))), _pair("f_WT", F.when(remote, F.lit("2"))),
    )
    return F.concat(F.lit("https://www.linkedin.com/jobs/search/?"), q)


def indeed(kw: Column, loc: Column, radius: Column, posted: Column, remote: Column) -> Column:
    q = _query(
        _pair("q", form_encoded(strip(kw))), _pair("l", form_encoded(present(strip(loc)))), _pair("radius", _number(radius)),
        _pair("fromage", _number(posted)), _pair("sc", F.when(remote, form_encoded(F.lit(REMOTE_ATTRIBUTE)))),
    )
    return F.concat(F.lit("https://de.indeed.com/jobs?"), q)


def search_url(site: Column, kw: Column, loc: Column, radius: Column, posted: Column, remote: Column) -> Column:
    """Null without a keyword or for an unknown site."""
    args = (kw, loc, radius, posted, F.coalesce(remote, F.lit(False)))
    some = F.coalesce(strip(kw), F.lit("")) != ""
    return (
        F.when(some & (site == "stepstone"), stepstone(*args)).when(some & (site == "linkedin"), linkedin(*args)).when(some & (site == "indeed"), indeed(*args))
    )


def pages(n: Column) -> Column:
    """Number of pages to collect: 1 to 15, and 3 where none is given."""
    return F.greatest(F.lit(1), F.least(F.lit(15), F.coalesce(F.nullif(n, F.lit(0)), F.lit(3))))


