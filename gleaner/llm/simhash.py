"""SimHash fingerprints of texts and a search of them within a Hamming radius; DataFrame operations only.

A text's terms are its distinct words, of weight 1, and its runs of five words, of weight 2 for each time that they occur. A term's 128 bits vote by their signs and by the term's weight; a
fingerprint has the bits that more than half of the weight is for. Votes are summed four to a number, in lanes of 16 bits.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import in_parts
from .sqlbits import crc32_of_text
from .store import materialize
from .textsql import WORD, lower_ascii

WORDS, BITS, RADIUS = 5, 128, 6
#: Seeds of the four 32-bit words of a term's hash.
SEEDS = (0x243F6A88, 0x85A308D3, 0x13198A2E, 0x03707344)
#: Terms whose votes a lane holds, and documents that follow each other in one task.
PIECE, CHUNK = 15000, 32
_M = 0xFFFFFFFF
_FIRST, _NEXT, _BY = 2166136261, 16777619, 0x45D9F3B  # any odd numbers of at most 27 bits do for the latter two
LANES = [f"v{k}" for k in range(BITS // 4)]


def _mixed(x: Column, seed: int) -> Column:
    """32 well mixed bits of a 32-bit number; no product is beyond 63 bits."""
    x = x.bitwiseXOR(F.lit(seed).cast("long"))
    for _ in range(2):
        x = (F.shiftright(x, 16).bitwiseXOR(x) * _BY).bitwiseAND(_M)
    return F.shiftright(x, 16).bitwiseXOR(x)


def terms(text: Column) -> Column:
    """An array of a text's terms: 32 bits each, with bit 32 set for a run of words. Words are lower-cased (A-Z); of fewer than five all together are one run; a null or blank
    text has none."""
    codes = F.transform(F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: F.crc32(w.cast("binary")))

    def all_of(c: Column) -> Column:
        n = F.size(c)
        fold = lambda h, x: ((h.bitwiseXOR(x)) * _NEXT).bitwiseAND(_M)
        start = F.lit(_FIRST).cast("long")
        step = lambda i: fold(fold(fold(fold(fold(start, F.get(c, i)), F.get(c, i + 1)), F.get(c, i + 2)), F.get(c, i + 3)), F.get(c, i + 4))
        runs = F.when(n >= WORDS, F.transform(F.sequence(F.lit(0), n - WORDS), step)).when(n > 0, F.array(F.aggregate(c, start, fold)))
        runs = F.coalesce(runs, F.array().cast("array<bigint>"))
        return F.concat(F.array_distinct(c), F.transform(runs, lambda x: x + (1 << 32)))

    return F.element_at(F.transform(F.array(codes), all_of), 1)  # an array of one, so that the words are found once


def _votes(term: Column) -> list[Column]:
    """What a term (null: nothing) adds to the lanes: a bit of its hash in each, times its weight."""
    weight = F.shiftright(term, 32) + 1
    spread, mask = 1 + (1 << 15) + (1 << 30) + (1 << 45), 1 + (1 << 16) + (1 << 32) + (1 << 48)
    out = []
    for w in range(BITS // 32):
        for k in range(8):
            nibble = F.shiftright(F.col(f"w{w}"), 4 * k).bitwiseAND(15)
            out.append(F.coalesce((nibble * spread).bitwiseAND(mask) * weight, F.lit(0).cast("long")))
    return out


def fingerprints(rows: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """by and f0 to f3, the 32-bit words of the fingerprint of each row's text; by: columns that tell rows apart. Rows that come dealt by one of `by` are not shuffled again. A text of
    any length is voted on in pieces; one without terms has no bit set."""
    each = rows.select(*by, F.posexplode_outer(terms(F.col(text))).alias("at", "term"))
    base = F.col("term").bitwiseAND(_M)
    each = each.select(*by, F.expr(f"coalesce(at, 0) div {PIECE}").alias("piece"), "term", *[_mixed(base, s).alias(f"w{k}") for k, s in enumerate(SEEDS)])
    weight = F.sum(F.coalesce(F.shiftright("term", 32) + 1, F.lit(0).cast("long"))).alias("weight")
    lanes = each.groupBy(*by, "piece").agg(weight, *[F.sum(v).alias(n) for v, n in zip(_votes(F.col("term")), LANES)])
    half = 0x0000FFFF0000FFFF  # lanes of 32 bits for the sums over pieces
    wide = [F.sum(F.shiftrightunsigned(n, 16 * odd).bitwiseAND(half)).alias(f"{n}_{odd}") for n in LANES for odd in (0, 1)]
    sums = lanes.groupBy(*by).agg(F.sum("weight").alias("weight"), *wide)
    words = []
    for w in range(BITS // 32):
        word = F.lit(0).cast("long")
        for b in range(32):
            lane = F.col(f"{LANES[w * 8 + b // 4]}_{b % 2}")
            count = F.shiftright(lane, 32) if b % 4 >= 2 else lane.bitwiseAND(_M)
            word = word + F.when(2 * count > F.col("weight"), 1 << b).otherwise(0)
        words.append(word.alias(f"f{w}"))
    return sums.select(*by, *words)


FP = [f"f{w}" for w in range(BITS // 32)]


def shown(words: Sequence[Column]) -> Column:
    """A fingerprint as 32 hexadecimal digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(w), 8, "0") for w in words]))


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = F.lit(0)
    for x, y in zip(a, b):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def within(queries: DataFrame, all_of: DataFrame, radius: int = RADIUS, blocks: int | None = None, exact: int = 2) -> DataFrame:
    """All pairs of a fingerprint of `queries` (q0 to q3, distinct) with one of `all_of` (f0 to f3, distinct) of at most `radius` different bits, with their distance.

    The bits are cut into blocks, radius + exact of them unless more are asked for; `exact` of them at least agree in such a pair. There is a table for each choice of `exact` blocks, with these permuted
    to the front: in it a query meets what has the same front. A pair is taken from the first table that holds it. Long fronts keep tables selective: with 16 bits a block and two blocks, about one
    chance meeting for every four billion fingerprints.
    """
    blocks = blocks or radius + exact
    if blocks < radius + exact or blocks > BITS:
        raise ValueError("so many blocks leave no agreement within the radius")
    cuts = [BITS * k // blocks for k in range(blocks + 1)]

    def block(words: Sequence[Column], k: int) -> Column:
        out = None
        for w in range(cuts[k] // 32, (cuts[k + 1] - 1) // 32 + 1):
            low, high = max(cuts[k], 32 * w), min(cuts[k + 1], 32 * w + 32)
            piece = F.shiftright(words[w], low - 32 * w).bitwiseAND((1 << (high - low)) - 1)
            out = piece if out is None else F.shiftleft(piece, low - cuts[k]).bitwiseOR(out)
        return out

    choices = list(combinations(range(blocks), exact))

    def fronts(df: DataFrame, names: Sequence[str]) -> DataFrame:
        words = [F.col(n) for n in names]
        front = [F.array(*[block(words, k) for k in choice]).cast("array<bigint>") for choice in choices]
        return df.select(*names, F.posexplode(F.array(*front)).alias("table", "front"))

    q = [f"q{w}" for w in range(BITS // 32)]
    left, right = fronts(queries, q), fronts(all_of, FP)
    qs, fs = [F.col(c) for c in q], [F.col(c) for c in FP]
    agree = [(block(qs, k) == block(fs, k)) for k in range(blocks)]
    first = F.lit(None).cast("int")
    for t, choice in reversed(list(enumerate(choices))):
        both = agree[choice[0]]
        for k in choice[1:]:
            both = both & agree[k]
        first = F.when(both, t).otherwise(first)
    near = distance(qs, fs)
    pairs = left.withColumnRenamed("front", "front_q").withColumnRenamed("table", "table_q")
    # Merged, as Spark would judge the size of the fronts by that of the queries that they are made of, and broadcast many times as much.
    met = pairs.hint("merge").join(right, (F.col("table_q") == F.col("table")) & (F.col("front_q") == F.col("front")) & (near <= radius) & (first == F.col("table")))
    return met.select(*q, *FP, near.alias("distance"))


def followed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in chunks of documents that follow each other in descending order of doc_id: chunk, off (the order in it), doc_id, text, next_text, ghost.

    Null ids come last, equal ids go on by a hash of their texts. The last document is followed by the first. Each chunk ends with the first document of the next one, a ghost."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("h").asc()]
    rows = in_parts(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")), order, "followed").drop("h")
    parts = rows.groupBy("__part").agg((F.expr(f"max(__off) div {CHUNK}")).alias("last"))
    all_parts = Window.orderBy("__part")  # a row for each part
    last_of_all = Window.orderBy(F.col("__part").desc())
    parts = parts.withColumns({"p": F.coalesce(F.lag("__part").over(all_parts), F.first("__part").over(last_of_all)), "q": F.coalesce(F.lag("last").over(all_parts), F.first("last").over(last_of_all))})
    own = rows.withColumns({"chunk": F.expr(f"__off div {CHUNK}"), "ghost": F.lit(False)})
    heads = rows.filter(f"__off % {CHUNK} = 0").join(F.broadcast(parts.select("__part", "p", "q")), "__part")
    inner = F.col("__off") > 0
    ghosts = heads.select(
        F.when(inner, F.col("__part")).otherwise(F.col("p")).alias("__part"), F.lit((1 << 62)).alias("__off"), "doc_id", "text",
        F.when(inner, F.expr(f"__off div {CHUNK} - 1")).otherwise(F.col("q")).alias("chunk"), F.lit(True).alias("ghost"),
    )
    chunk = F.concat_ws(".", "__part", "chunk").alias("chunk")
    both = own.select("__part", "__off", "doc_id", "text", "chunk", "ghost").unionByName(ghosts)
    return both.select(chunk, F.col("__off").alias("off"), "doc_id", "text", "ghost").withColumn("next_text", F.lead("text").over(Window.partitionBy("chunk").orderBy("off")))


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Every row of documents with its fingerprint, that of its edited text, their likeness and that to the next document's (the share of equal bits), and n_within: for ids that 50 divides, how many other
    documents have a fingerprint within `radius` bits.

    A null text is empty; a text without words has a fingerprint without bits. Rows of one id follow each other by a hash of their texts; equal rows stay rows."""
    n = F.length("text")
    rest = F.expr("length(text) div 2")
    edited = F.concat(F.substring("text", F.lit(1), n - rest), F.substring("next_text", F.lit(1), rest))
    rows = followed(docs).withColumn("edited", F.coalesce(edited, F.lit("")))
    by = ["chunk", "off", "ghost", "doc_id", "n_chars", "edited_sha256", "kind"]
    both = rows.select("chunk", "off", "ghost", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("kind", "text"))
    found = fingerprints(both, by)
    of_kind = lambda k: [F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{c}_{k}") for c in FP]
    wide = found.groupBy(*by[:-1]).agg(*of_kind(0), *of_kind(1))
    w = Window.partitionBy("chunk").orderBy("off")
    wide = wide.withColumns({f"{c}_n": F.lead(f"{c}_0").over(w) for c in FP}).filter("NOT ghost")
    wide = materialize(wide, "fingerprints")
    own, new, after = ([F.col(f"{c}_{k}") for c in FP] for k in ("0", "1", "n"))
    fps = wide.groupBy(*[c.alias(f) for c, f in zip(own, FP)]).agg(F.count("*").alias("n"))
    asked = wide.filter("doc_id % 50 = 0").select(*[c.alias(f"q{k}") for k, c in enumerate(own)]).distinct()
    q = [f"q{k}" for k in range(len(FP))]
    met = within(asked, fps.drop("n"), radius).join(fps, FP).groupBy(*q).agg((F.sum("n") - 1).alias("n_within"))
    likeness = lambda x: F.lit(1.0) - distance(own, x) / F.lit(float(BITS))
    out = wide.select("doc_id", "n_chars", "edited_sha256", shown(own).alias("fingerprint"), shown(new).alias("edited_fingerprint"), likeness(new).alias("near_edited"), likeness(after).alias("near_next"), *[c.alias(k) for c, k in zip(own, q)])
    asked_for = out.filter("doc_id % 50 = 0").join(met, q, "left")
    rest_of = out.filter("coalesce(doc_id % 50 <> 0, true)").withColumn("n_within", F.lit(None).cast("long"))
    return asked_for.unionByName(rest_of).drop(*q)


def _mixed_sql(x: str, seed: int) -> str:
    one = "(xor({0} >> 16, {0}) * " + str(_BY) + " & " + str(_M) + ")"
    return f"list_transform([list_transform([list_transform([xor({x}, {seed})], lambda a: {one.format('a')})[1]], lambda b: {one.format('b')})[1]], lambda c: xor(c >> 16, c))[1]"


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


_BIT = [f"CAST(sum(CASE WHEN (w{b // 32} >> {b % 32}) & 1 = 1 THEN weight ELSE 0 END) * 2 > sum(weight) AS INTEGER)" for b in range(BITS)]
_HEX = " || ".join("printf('%08x', coalesce(" + " + ".join(f"(CAST({_BIT[32 * w + b]} AS BIGINT) << {b})" for b in range(32)) + ", 0))" for w in range(BITS // 32))

ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS i FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY i), first_value(text) OVER (ORDER BY i)) AS after FROM d),
e AS (SELECT i, doc_id, text, substr(text, 1, length(text) - length(text) // 2) || substr(after, 1, length(text) // 2) AS edited FROM n),
x AS (SELECT i, 0 AS kind, {_words_sql('text')} AS words FROM e UNION ALL SELECT i, 1, {_words_sql('edited')} FROM e),
v AS (SELECT w, {crc32_of_text('w')} AS c FROM (SELECT DISTINCT unnest(words) AS w FROM x)),
u AS (SELECT i, kind, unnest(words) AS w, generate_subscripts(words, 1) AS place FROM x),
c AS (SELECT i, kind, place, c FROM u JOIN v USING (w)),
g AS (SELECT i, kind, place, c, list(c) OVER (PARTITION BY i, kind ORDER BY place ROWS BETWEEN CURRENT ROW AND {WORDS - 1} FOLLOWING) AS run, count(*) OVER (PARTITION BY i, kind) AS n FROM c),
t AS (SELECT DISTINCT i, kind, c AS b, 1 AS weight FROM g
  UNION ALL SELECT i, kind, list_reduce(list_prepend(CAST({_FIRST} AS BIGINT), run), lambda h, y: xor(h, y) * {_NEXT} & {_M}), 2 FROM g WHERE place = 1 OR len(run) = {WORDS}),
h AS (SELECT i, kind, weight, {', '.join(f"{_mixed_sql('b', s)} AS w{k}" for k, s in enumerate(SEEDS))} FROM t),
s AS (SELECT i, kind, {_HEX} AS fp FROM (SELECT i, kind, 0 AS weight, 0 AS w0, 0 AS w1, 0 AS w2, 0 AS w3 FROM x UNION ALL SELECT * FROM h) GROUP BY i, kind),
f AS (SELECT e.i, doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint FROM e JOIN s a ON a.i = e.i AND a.kind = 0 JOIN s b ON b.i = e.i AND b.kind = 1),
l AS (SELECT *, coalesce(lead(fingerprint) OVER (ORDER BY i), first_value(fingerprint) OVER (ORDER BY i)) AS follows FROM f),
p AS (SELECT q.doc_id, count(*) - 1 AS n_within FROM f q JOIN f a ON {{far}} <= {RADIUS} WHERE q.doc_id % 50 = 0 GROUP BY q.doc_id)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, 1.0 - {{edited}} / {BITS}.0 AS near_edited, 1.0 - {{next}} / {BITS}.0 AS near_next, n_within FROM l LEFT JOIN p USING (doc_id)
"""


def _apart(a: str, b: str) -> str:
    half = lambda c, k: f"CAST('0x' || substr({c}, {8 * k + 1}, 8) AS BIGINT)"
    return "(" + " + ".join(f"bit_count(xor({half(a, k)}, {half(b, k)}))" for k in range(BITS // 32)) + ")"


ORACLE = ORACLE.format(far=_apart("q.fingerprint", "a.fingerprint"), edited=_apart("fingerprint", "edited_fingerprint"), next=_apart("fingerprint", "follows"))
