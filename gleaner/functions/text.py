"""Text functions over columns. Absent means null or empty throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a browser counts as white space; badge phrases that list pages append to titles.
SPACE = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
BADGES = (
    "with verification",
    "easy apply",
    "promoted",
    "viewed",
    "new",
    "verified",
    "be an early applicant",
    "actively reviewing applicants",
    "reposted",
)
BADGE_PASSES = 4
LEAST_REPEAT = 4


def once(c: Column, body) -> Column:
    """body(c) with c worked out once a row, however often body uses it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def present(c: Column) -> Column:
    """c, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def first_present(*cs: Column) -> Column:
    """The first that is not absent, else empty."""
    return F.coalesce(*[present(c) for c in cs], F.lit(""))


def strip(c: Column) -> Column:
    """Without white space, as browsers define it, at either end."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+\\z", "")


def squeeze(c: Column) -> Column:
    """An element's text: runs of white space are one blank, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " "))


def without_badges(c: Column) -> Column:
    """A title without up to four badge phrases at its end. A phrase needs no word boundary before it."""
    pattern = f"(?i){SPACE}*({'|'.join(BADGES)}){SPACE}*\\z"
    out = strip(F.coalesce(c, F.lit("")))
    for _ in range(BADGE_PASSES):  # once nothing is removed, further passes change nothing
        out = strip(F.regexp_replace(out, pattern, ""))
    return out


def collapsed(c: Column) -> Column:
    """Text whose first half at most is at once repeated, with one character between or none: that half, the
    longest such of four characters or more. What follows the repeat is dropped."""

    def longest(x: Column) -> Column:
        def again(h: Column) -> Column:
            head = F.left(x, h)
            return ((2 * h + 1 <= F.length(x)) & (head == F.substring(x, h + 2, h))) | (head == F.substring(x, h + 1, h))

        halves = F.sequence((F.length(x) / 2).cast("int"), F.lit(LEAST_REPEAT), F.lit(-1))
        found = F.try_element_at(F.filter(halves, again), F.lit(1))
        return F.coalesce(F.when(F.length(x) >= 2 * LEAST_REPEAT, F.trim(F.left(x, found))), x)

    return once(c, longest)


def title_text(c: Column) -> Column:
    """A list page's title: no badges, no repeat."""
    return collapsed(without_badges(c))


def few_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def bullet_label(c: Column) -> Column:
    """The bold text that a bullet begins with, without one closing colon; empty if there is none."""
    return F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), "(?d)^\\s*<b>(.*?):?</b>", 1))


def escape_html(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def base_name(path: Column) -> Column:
    """A path's last part; slashes at its end don't count."""
    return F.coalesce(F.try_element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), F.lit(-1)), F.lit(""))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), f"{SPACE}+", "-")


def unnamed(company: Column) -> Column:
    return F.coalesce(present(company), F.lit("(unnamed)"))


def job_label(title: Column, url: Column, none: str = "open a job to mark it applied") -> Column:
    return F.coalesce(present(title), present(url), F.lit(none))


def run_text(error: Column, stopped: Column, collected: Column, of: Column, added: Column, total: Column) -> Column:
    """What a collecting run came to; numbers that are missing count as 0."""
    n = lambda c: F.coalesce(c.cast("string"), F.lit("0"))
    return (
        F.when(present(error).isNotNull(), F.concat(F.lit("error: "), error))
        .when(F.coalesce(stopped, F.lit(False)), F.concat(F.lit("stopped at "), n(collected), F.lit("/"), n(of), F.lit(" · +"), n(added), F.lit(" new kept")))
        .otherwise(F.concat(F.lit("+"), n(added), F.lit(" new ("), n(total), F.lit(" total)")))
    )


def applied_text(ok: Column, added: Column, total: Column, matches: Column) -> Column:
    """What marking a job as applied came to."""
    return (
        F.when(~F.coalesce(ok, F.lit(False)), F.lit("pipeline offline — not recorded"))
        .when(F.coalesce(added, F.lit(0)) != 0, F.concat(F.lit("marked applied · "), total.cast("string"), F.lit(" total · "), matches.cast("string"), F.lit(" still ranked")))
        .otherwise(F.lit("already on the applied list"))
    )


def status_text(collected_today: Column, applied: Column, matches: Column) -> Column:
    """A one-line summary; the ranked part only where the number is known, 0 included."""
    return F.concat(
        F.lit("pipeline up · "), collected_today.cast("string"), F.lit(" today · "), applied.cast("string"), F.lit(" applied"),
        F.coalesce(F.concat(F.lit(" · "), matches.cast("string"), F.lit(" ranked")), F.lit("")),
    )


def built_text(date: Column, rank: Column) -> Column:
    return F.coalesce(F.concat(F.lit("✓ documents built "), date, F.lit(" (#"), rank.cast("string"), F.lit(")")), F.lit(""))


def progress(text: Column) -> Column:
    """(percent, moving): the last fraction a/b with b > 0 gives the percentage, 100 at most; other text moves
    without a percentage; empty text leaves both null."""

    def of(last: Column) -> Column:
        a = F.regexp_extract(last, "^(\\d+)", 1).try_cast("double")
        b = F.regexp_extract(last, "(\\d+)$", 1).try_cast("double")
        percent = F.when(b > 0, F.least(F.lit(100.0), a / F.nullif(b, F.lit(0.0)) * 100))
        return F.struct(percent.alias("percent"), F.when(percent.isNotNull(), F.lit(False)).when(F.coalesce(text, F.lit("")) != "", F.lit(True)).alias("moving"))

    return once(F.try_element_at(F.regexp_extract_all(text, F.lit("\\d+\\s*/\\s*\\d+"), F.lit(0)), F.lit(-1)), of)


def minute_stamp(at: Column) -> Column:
    """A time as part of a file name."""
    return F.date_format(at, "yyyy-MM-dd-HH-mm")


def list_text(values: Column, sep: str = " ") -> Column:
    return F.coalesce(F.array_join(values, sep), F.lit(""))


def haystack(parts: Sequence[Column], flags: Column) -> Column:
    """What a card's filter looks in. A missing part is the word none; missing flags are nothing."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("None")) for p in parts], list_text(flags)))
