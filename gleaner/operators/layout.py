"""Documents as ordered rows of style and text; the drawing of pages is left to others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import present

# A finished file's least size, and what padding adds beyond it.
FLOOR = 8192
MARGIN = 64

_ROW = "array<struct<style:string,text:string>>"


def _line(style: str, text: Column) -> Column:
    return F.struct(F.lit(style).alias("style"), text.alias("text"))


def _lines(style: str, texts: Column) -> Column:
    return F.coalesce(F.transform(texts, lambda t: _line(style, t)), F.array().cast(_ROW))


def _maybe(style: str, text: Column) -> Column:
    return F.when(present(text).isNotNull(), F.array(_line(style, text))).otherwise(F.array().cast(_ROW))


def heading(role: Column, org: Column) -> Column:
    return F.concat(role, F.coalesce(F.concat(F.lit(", "), present(org)), F.lit("")))


def skill(label: Column, value: Column) -> Column:
    return F.concat(F.lit("<b>"), label, F.lit(":</b> "), value)


def _flow(df: DataFrame, flow: Column) -> DataFrame:
    return df.select("path", F.posexplode(flow).alias("ord", "l")).select("path", "ord", "l.style", "l.text")


def cv(cvs: DataFrame) -> DataFrame:
    """(path, ord, style, text): name, tagline?, contact, rule, summary?, then each section's title, rule and items."""
    item = lambda i: F.concat(
        F.array(_line("role", heading(i["role"], i["org"]))), _maybe("meta", i["meta"]), _lines("bullet", i["bullets"])
    )
    section = lambda s: F.concat(
        F.array(_line("section", F.upper(s["title"])), _line("rule", F.lit(""))),
        F.coalesce(F.transform(s["skills"], lambda k: _line("skill", skill(k["label"], k["value"]))), F.array().cast(_ROW)),
        F.coalesce(F.flatten(F.transform(s["items"], item)), F.array().cast(_ROW)),
    )
    return _flow(
        cvs,
        F.concat(
            F.array(_line("name", F.col("name"))), _maybe("tagline", F.col("tagline")), _lines("contact", F.col("contact")), F.array(_line("rule", F.lit(""))),
            _maybe("body", F.col("summary")), F.coalesce(F.flatten(F.transform("sections", section)), F.array().cast(_ROW)),
        ),
    )


def letter(letters: DataFrame) -> DataFrame:
    """(path, ord, style, text): sender, recipient, date, subject, salutation, paragraphs, closing, signature."""
    rest = F.slice("sender", 2, F.greatest(F.size("sender") - 1, F.lit(0)))
    one = lambda style, c: F.array(_line(style, F.col(c)))
    return _flow(
        letters,
        F.concat(
            F.array(_line("name", F.get("sender", F.lit(0)))), _lines("meta", rest), _lines("meta", F.col("recipient")), one("meta", "date"), one("subject", "subject"),
            one("body", "salutation"), _lines("body", F.col("paragraphs")), one("body", "closing"), one("body", "signature"),
        ),
    )


def finished_size(size: Column, floor: int = FLOOR) -> Column:
    """Bytes of a file once padded: one below the floor gets a comment (two bytes more than its filling) before its last cross-reference pointer."""
    return F.when(size < floor, size + 2 + (floor - size + MARGIN)).otherwise(size)
