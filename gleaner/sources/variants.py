"""Payloads without a fixed form, as VARIANT: parsed once, common paths as columns of their own."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shredded(rows: DataFrame, payload: str, paths: Mapping[str, tuple[str, str]]) -> DataFrame:
    """rows with a column for each of `paths` (name to path and type), `malformed`, `mistyped` and `whole`; these replace columns of such names, and the payload goes.

    whole: the payload as a VARIANT, null where it is null, empty or no JSON; malformed tells the latter two from the first. A path that is absent, or whose value is JSON's null, gives null. So does a value that
    can't be read as the type; mistyped has the names of those, in order, and no other. Texts that spell a number are numbers. A table of these columns is read by column; only paths that are asked for seldom need the whole.
    """
    new = [*paths, "malformed", "mistyped", "whole"]
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in (payload, *new)]
    parsed = rows.select(*kept, F.col(f"`{payload}`").alias("__payload"), F.try_parse_json(f"`{payload}`").alias("whole"))
    found = {name: F.try_variant_get("whole", path, kind) for name, (path, kind) in paths.items()}
    there = {name: F.try_variant_get("whole", path, "variant") for name, (path, _) in paths.items()}
    wrong = [F.when(there[n].isNotNull() & ~F.is_variant_null(there[n]) & found[n].isNull(), F.lit(n)) for n in paths]
    return parsed.select(
        *[c for c in kept], *[found[n].alias(n) for n in paths], (F.col("__payload").isNotNull() & F.col("whole").isNull()).alias("malformed"), F.array_compact(F.array(*wrong)).alias("mistyped"), "whole"
    )
