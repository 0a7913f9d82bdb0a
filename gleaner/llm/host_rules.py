"""Quality rules judged per document and per host.

Each rule gives a failure flag per document. Failures are summed per host, the
hosts' rates are shrunk by an empirical beta prior (method of moments over the
hosts), and a host whose shrunk rate is above a rule's limit, which follows from
that prior, loses all its documents. Native expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .textsql import BLANKS, WORD

SYMBOLS = "#*$%&|<>"
GRAM = 8
MIN_WORDS = 20
MAX_REPEAT = 30  # percent of words
#: A host fails if its shrunk failure rate for any rule lies more than so many of the prior's standard deviations above the prior's mean. The limit is
#: never below the first nor above the second of these rates.
HOST_DEVIATIONS, HOST_LEAST, HOST_MOST = 3.0, 0.4, 0.8
PRIOR_LEAST, PRIOR_MOST = 1.0, 1000.0


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words,
    which replace columns of these names; text itself is dropped.

    Null counts as empty. A line counts as repeated if it holds a word and equals an
    earlier line. A repeated word lies in a window of eight words that the text holds
    twice or more; windows are compared by 64-bit hashes of 64-bit word hashes.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]
    keep = [F.col(f"`{c}`") for c in df.columns if c != text and c not in made]
    t = F.coalesce(F.col(text), F.lit(""))
    one = df.select(
        *keep,
        F.transform(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("__wh"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)).alias("__lines"),
    )
    n = F.size("__wh")
    two = one.select(
        *keep, "word_chars", "n_symbols", n.cast("long").alias("n_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            n >= GRAM,
            F.transform(F.sequence(F.lit(0), n - GRAM), lambda i: F.xxhash64(*[F.get("__wh", i + k) for k in range(GRAM)])),
        ).otherwise(F.array().cast("array<bigint>")).alias("__g"),
    )
    three = two.select(
        *keep, "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines",
        F.when(
            F.size(F.array_distinct("__g")) < F.size("__g"),
            F.sort_array(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("__s"),
    )
    again = lambda x, j: (x["h"] == F.get("__s", j - 1)["h"]) | (x["h"] == F.get("__s", j + 1)["h"])
    four = three.select(
        *keep, *[c for c in made if c != "n_repeat_words"],
        F.sort_array(
            F.filter(F.transform("__s", lambda x, j: F.when(again(x, j), x["i"])), lambda i: i.isNotNull())
        ).alias("__at"),
    )
    steps = F.transform("__at", lambda i, j: F.least(F.lit(GRAM), F.coalesce(F.get("__at", j + 1) - i, F.lit(GRAM))))
    return four.select(
        *keep, *[c for c in made if c != "n_repeat_words"],
        F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def rules() -> dict[str, Column]:
    """Name and failure of each rule, over the columns of measure()."""
    return {
        "few_words": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") > 12 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words")),
    }


def judge_hosts(measured: DataFrame, host: Column, deviations: float = HOST_DEVIATIONS, least: float = HOST_LEAST) -> DataFrame:
    """One row per host (null is a host): host, n, host_ok and each rule's shrunk rate and limit."""
    fails = rules()
    per = measured.groupBy(host.alias("host")).agg(
        F.count("*").alias("n"), *[F.sum(f.cast("long")).alias(f"f_{k}") for k, f in fails.items()]
    )
    per = materialize(per, "hosts")
    moments = per.agg(*[g(F.col(f"f_{k}") / F.col("n")).alias(f"{p}_{k}") for k in fails for p, g in (("m", F.avg), ("v", F.var_pop))]).first()
    rates, limits = {}, {}
    for k in fails:
        m, v = moments[f"m_{k}"] or 0.0, moments[f"v_{k}"] or 0.0
        strength = min(PRIOR_MOST, max(PRIOR_LEAST, m * (1 - m) / v - 1)) if v > 0 else PRIOR_MOST
        rates[k] = (F.col(f"f_{k}") + m * strength) / (F.col("n") + strength)
        limits[k] = min(HOST_MOST, max(least, m + deviations * (m * (1 - m) / (strength + 1)) ** 0.5))
    ok = F.lit(True)
    for k, r in rates.items():
        ok = ok & (r <= limits[k])
    return per.select("host", "n", ok.alias("host_ok"), *[x.alias(f"{p}_{k}") for k in rates for p, x in (("rate", rates[k]), ("limit", F.lit(limits[k])))])


def apply_host_rules(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """docs without text, with measure()'s columns, base_failed and kept.

    An empty table gives no rows. Rows that are repeated are judged each on its own.
    The join's host side is one row per host; Spark broadcasts it only below its own
    size threshold and otherwise splits hot hosts.
    """
    rows = materialize(measure(docs, text), "measured")
    verdicts = judge_hosts(rows, F.col(host)).select(F.col("host").alias("__host"), "host_ok")
    r = rules()
    base = r["few_words"] | r["repeats"]
    return (
        rows.join(verdicts, F.col(host).eqNullSafe(F.col("__host")), "left")
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True)))
        .drop("__host")
    )


#: The host of a document where short texts are made to have one of their own, in Spark and in DuckDB.
BAD_HOST = "CASE WHEN length(text) < 300 THEN 'short.example' ELSE source END"


def quality_documents(docs: DataFrame) -> DataFrame:
    """One row for every row of documents; null and empty texts have no words and fail. A null source is a host."""
    out = apply_host_rules(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def bad_host_documents(docs: DataFrame) -> DataFrame:
    """quality_documents where one host fails: documents under 300 characters are put on a host of their own."""
    return quality_documents(docs.withColumn("source", F.expr(BAD_HOST)))


def _oracle(source: str = "source") -> str:
    flags = {
        "few_words": f"n_words < {MIN_WORDS}",
        "repeats": f"100 * n_repeat_words > {MAX_REPEAT} * n_words",
        "symbols": "10 * n_symbols > n_words",
        "dup_lines": "10 * n_dup_lines > 3 * n_lines",
        "word_length": "(word_chars > 12 * n_words OR word_chars < 2 * n_words)",
    }
    per = ", ".join(f"sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS f_{k}" for k, c in flags.items())
    moments = ", ".join(f"avg(f_{k} / n) AS m_{k}, var_pop(f_{k} / n) AS v_{k}" for k in flags)
    strength = "CASE WHEN v_{k} > 0 THEN least({b}, greatest({a}, m_{k} * (1 - m_{k}) / v_{k} - 1)) ELSE {b} END"
    ok = " AND ".join(
        f"(f_{k} + m_{k} * ({s})) / (n + ({s})) <= least({HOST_MOST}, greatest({HOST_LEAST}, m_{k} + {HOST_DEVIATIONS} * sqrt(m_{k} * (1 - m_{k}) / (({s}) + 1))))"
        for k in flags
        for s in [strength.format(k=k, a=PRIOR_LEAST, b=PRIOR_MOST)]
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {source} AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
        [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS ls FROM d),
g AS (SELECT rid, i, array_to_string(ws[i + 1:i + {GRAM}], ' ') AS s
        FROM (SELECT rid, ws, unnest(range(0, len(ws) - {GRAM - 1})) AS i FROM w WHERE len(ws) >= {GRAM})),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, sum(least({GRAM}, coalesce(nx - i, {GRAM}))) AS k
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM r) GROUP BY rid),
m AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(k, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN c USING (rid)),
h AS (SELECT source, count(*) AS n, {per} FROM m GROUP BY source),
p AS (SELECT {moments} FROM h),
v AS (SELECT source, {ok} AS host_ok FROM h, p)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words) AND host_ok AS kept
FROM m JOIN v ON m.source IS NOT DISTINCT FROM v.source
"""


ORACLE = _oracle()
BAD_HOST_ORACLE = _oracle(BAD_HOST)
