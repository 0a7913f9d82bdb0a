"""Applied and skipped marks, folded from an event log without a loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.keys import mark_key


def _last_is(kinds: Column, wanted: Column, seq: str) -> Column:
    """Whether the last event among `kinds` is `wanted`."""
    return F.coalesce(F.max_by(wanted, F.when(kinds, F.col(seq))), F.lit(False))


def fold(events: DataFrame, by: Sequence[str] = ("url",), seq: str = "seq") -> DataFrame:
    """applied and skipped of each key. events: kind (applied, skipped or reset), checked, seq.

    A tick sets its mark and clears the other; an untick clears its own. So applied holds
    if, of the events that touch it, the last is its tick. A reset clears both.
    """
    kind, on = F.col("kind"), F.col("checked")
    reset = kind == "reset"
    a, s = kind == "applied", kind == "skipped"
    return events.groupBy(*by).agg(
        _last_is(a | (s & on) | reset, a & on, seq).alias("applied"),
        _last_is(s | (a & on) | reset, s & on, seq).alias("skipped"),
    )


def after_reset(events: DataFrame, resets: DataFrame, by: str = "batch_date") -> DataFrame:
    """Events of each batch since its last reset. resets: batch, seq."""
    last = resets.groupBy(by).agg(F.max("seq").alias("__reset"))
    return events.join(last, by, "left").filter("__reset IS NULL OR seq > __reset").drop("__reset")


def applied_urls(events: DataFrame) -> DataFrame:
    """Addresses that were ever ticked as applied; unticking takes none back."""
    return events.filter("kind = 'applied' AND checked").groupBy("url").agg(F.min("seq").alias("first_seq"))


def with_marks(cards: DataFrame, marks: DataFrame) -> DataFrame:
    """Cards with applied, skipped and done. Cards without an address share one key; so do equal addresses."""
    m = marks.select(F.col("url").alias("__url"), "applied", "skipped")
    joined = cards.join(m, mark_key(F.col("url")) == F.col("__url"), "left").drop("__url")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("applied", "skipped")})
    return joined.withColumn("done", F.col("applied") | F.col("skipped"))


def counts(marked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cards applied to, skipped (and not applied to) and left, and the shares of the first two in percent."""
    out = marked.groupBy(*by).agg(
        F.count_if(F.col("applied")).alias("n_applied"), F.count_if(~F.col("applied") & F.col("skipped")).alias("n_skipped"), F.count("*").alias("n")
    )
    whole = F.greatest("n", F.lit(1))
    return out.select(
        *by, "n_applied", "n_skipped", (F.col("n") - F.col("n_applied") - F.col("n_skipped")).alias("n_left"),
        (F.col("n_applied") / whole * 100).alias("applied_pct"), (F.col("n_skipped") / whole * 100).alias("skipped_pct"),
    )


def hide_done(marked: DataFrame, hidden: bool = True) -> DataFrame:
    return marked.filter(~F.col("done")) if hidden else marked
