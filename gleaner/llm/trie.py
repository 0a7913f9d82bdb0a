"""A prefix trie of conversations by partition refinement.

All conversations are one class at first, the root. A round splits the classes by their members' next turns, turn by turn: the first round by 8 turns, each later one by twice as
many, so that a long common beginning takes few rounds. A class of one is retired: what is left of its conversation is a unary chain that no further
round sees. What is gathered in subtrees is folded back over the shared nodes, from distances of 1, 2, 4 and so on.

A turn is told by the SHA-256 of its role and text, and a node by 128 bits over its turns and their depths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import in_parts, numbered
from .sqlbits import crc32_of_digits
from .store import materialize
from .textsql import word_count

#: Turns of the first round, and depths that a piece of a chain has at most.
FIRST_TURNS, PIECE = 8, 4096
NODE = ["k1", "k2"]


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def turns_in_order(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), n (turns of the conversation), token and words of turns(conv_id, turn, role, text), in order of turn, null first; turns that tie go on by their token. Null roles
    and texts are empty; rows without a conv_id belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    token = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", token.alias("token"), word_count(text).alias("words"))
    return numbered(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("token").asc()], "turns").select("conv_id", "pos", "n", "token", "words")


def _spelled(rows: DataFrame) -> DataFrame:
    """rows(conv_id, depth from 1, length, token, words) with a turn's part of its node."""
    return rows.withColumns({"h1": F.xxhash64("token", "depth"), "h2": F.xxhash64(F.lit(1), "token", "depth")}).drop("token")


def refine(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shared nodes, chains and ends of the trie.

    turns: conv_id, depth (1 to length), length, token, words. convs: conv_id and length, turnless conversations too. Shared nodes, the root and all of two members or more: k1, k2, depth,
    p1, p2 (the parent; null for the root), conv_id (the least member), n_convs and words (of the last turn). Chains, one for each conversation that is
    at some depth alone: conv_id, start (the first depth), length, p1 and p2. Ends, of all others: conv_id and its node, k1 and k2.
    """
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    null = F.lit(None).cast("long")
    root = root.select(_long(0).alias("k1"), _long(0).alias("k2"), _long(0).alias("depth"), null.alias("p1"), null.alias("p2"), "conv_id", "n_convs", _long(0).alias("words"))
    shared, chains = [root], []
    ends = [convs.filter("length = 0").select("conv_id", _long(0).alias("k1"), _long(0).alias("k2"))]
    left = _spelled(turns)
    active = convs.filter("length > 0").select("conv_id", _long(0).alias("k1"), _long(0).alias("k2"))
    low, size = 0, FIRST_TURNS
    while not active.isEmpty():
        high = low + size
        so_far = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
        rows = left.filter(f"depth <= {high}").join(active, "conv_id")
        xor = lambda k, h: F.expr(f"bit_xor({h})").over(so_far).bitwiseXOR(F.col(k))
        rows = rows.withColumns({"k1": xor("k1", "h1"), "k2": xor("k2", "h2")})
        rows = materialize(rows.select("conv_id", "depth", "length", "words", *NODE, F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("p2")), "round")
        classes = rows.groupBy(*NODE).agg(*[F.min(c).alias(c) for c in ("depth", "p1", "p2", "conv_id", "words", "length")], F.count("*").alias("n_convs"))
        classes = materialize(classes, "classes")
        shared.append(classes.filter("n_convs > 1").select(*root.columns))
        alone = classes.filter("n_convs = 1").groupBy("conv_id").agg(F.min("depth").alias("start"), *[F.min_by(c, "depth").alias(c) for c in ("length", "p1", "p2")])
        alone = materialize(alone.select("conv_id", "start", "length", "p1", "p2"), "alone")
        chains.append(alone)
        on = rows.join(alone.select("conv_id"), "conv_id", "left_anti")
        ends.append(on.filter("depth = length").select("conv_id", *NODE))
        active = materialize(on.filter(f"depth = {high} AND length > depth").select("conv_id", *NODE), "active")
        if not active.isEmpty():
            left = materialize(left.filter(f"depth > {high}").join(active.select("conv_id"), "conv_id", "left_semi"), "left")
        low, size = high, 2 * size
    none = turns.limit(0).select("conv_id", F.col("depth").alias("start"), "length", null.alias("p1"), null.alias("p2"))
    return materialize(_all(shared), "shared"), materialize(_all(chains or [none]), "chains"), materialize(_all(ends), "ends")


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def fold_back(nodes: DataFrame, values: Sequence[str]) -> DataFrame:
    """Nodes (k1, k2, p1, p2) with each of `values` summed over the subtree, in as many steps as the greatest depth has binary digits."""
    sums = {c: F.sum(c).alias(f"__{c}") for c in values}
    now = materialize(nodes.select(*NODE, F.col("p1").alias("a1"), F.col("p2").alias("a2"), *values), "fold")
    while not now.filter("a1 IS NOT NULL").isEmpty():
        given = now.filter("a1 IS NOT NULL").groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(*sums.values())
        far = now.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        grown = now.join(given, NODE, "left").withColumns({c: F.col(c) + F.coalesce(f"__{c}", _long(0)) for c in values})
        now = materialize(grown.join(far, ["a1", "a2"], "left").select(*NODE, F.col("b1").alias("a1"), F.col("b2").alias("a2"), *values), "fold")
    return now.select(*NODE, *values)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of node and conv_id as a text of ids for each node and batch."""
    for at, batch in enumerate(batches):
        if batch.num_rows:
            rows = batch.to_pandas()
            text = rows.assign(ids=rows["conv_id"].astype("int64").astype(str)).groupby(NODE, sort=False)["ids"].agg(",".join).reset_index()
            text["part"], text["at"] = rows["part"].iloc[0], at
            yield pa.RecordBatch.from_pandas(text[["k1", "k2", "part", "at", "ids"]], preserve_index=False)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of node, part and place as one digest for each node: a piece at a time, none is put together."""
    now, sha = None, None
    for batch in batches:
        done = []
        for k1, k2, ids in zip(*[batch.column(c).to_pylist() for c in ("k1", "k2", "ids")]):
            if now == (k1, k2):
                sha.update(b",")
            else:
                if sha:
                    done.append((*now, sha.hexdigest()))
                now, sha = (k1, k2), hashlib.sha256()
            sha.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "ends"), x)) for x in done], schema=_ENDS)
    if sha:
        yield pa.RecordBatch.from_pylist([{"k1": now[0], "k2": now[1], "ends": sha.hexdigest()}], schema=_ENDS)


_ENDS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends", pa.string())])


def end_digests(ends: DataFrame) -> DataFrame:
    """k1, k2 and ends: SHA-256 of the node's conv_ids, ascending, with commas between. The ids of a node may lie in many tasks; the last step reads pieces of text, not ids."""
    placed = in_parts(ends.select(*NODE, F.col("conv_id").cast("long").alias("conv_id")), [F.col(c).asc() for c in (*NODE, "conv_id")], "ended")
    pieces = placed.select(*NODE, "conv_id", F.col("__part").alias("part"), F.col("__off").alias("off")).repartition("part").sortWithinPartitions("part", "off")
    pieces = pieces.mapInArrow(_pieces, "k1 long, k2 long, part long, at long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "part", "at").mapInArrow(_digests, "k1 long, k2 long, ends string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie's nodes: conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256. turns and convs: as for refine(). No conversations, no nodes."""
    shared, chains, ends = refine(turns, convs)
    below = lambda df: df.filter("p1 IS NOT NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n"))
    kids, tails = below(shared).withColumnRenamed("n", "n_kids"), below(chains).withColumnRenamed("n", "n_tails")
    zero = lambda c: F.coalesce(c, _long(0))
    nodes = shared.join(kids, NODE, "left").join(tails, NODE, "left").withColumn("n_children", zero("n_kids") + zero("n_tails"))
    nodes = nodes.withColumns({"n_leaves": zero("n_tails") + (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
    nodes = materialize(nodes, "nodes")
    sums = fold_back(nodes, ["n_leaves", "saved_tokens"])
    up = shared.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    full = nodes.drop("n_leaves", "saved_tokens").join(sums, NODE).join(end_digests(ends), NODE, "left").join(up, ["p1", "p2"], "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    full = full.withColumn("ends_sha256", F.coalesce("ends", F.lit(none))).select(*columns)
    # A chain's nodes, in pieces so that no array grows with it.
    runs = chains.join(up, ["p1", "p2"], "left").withColumn("at", F.explode(F.expr(f"sequence(start, length, {PIECE}L)")))
    each = runs.withColumn("depth", F.explode(F.expr(f"sequence(at, least(at + {PIECE - 1}L, length))")))
    last = F.col("depth") == F.col("length")
    alone = each.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("start"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), _long(1).alias("n_convs"),
        (~last).cast("long").alias("n_children"), _long(1).alias("n_leaves"), _long(0).alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none).alias("ends_sha256"),
    )
    return full.unionByName(alone)


def rebuild(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their group does: (turns, convs) for trie().

    Conversation c begins with the first h turns of conversation c - c % group (fewer if it has fewer, none where it is absent) and goes on with its own after its
    first h; h is the unsigned CRC-32 of c in decimals, modulo most. turns: of turns_in_order()."""
    own = materialize(turns, "own")
    sizes = own.filter("pos = 0").select("conv_id", "n")
    c = F.col("conv_id")
    convs = sizes.withColumns({"h": F.crc32(c.cast("string").cast("binary")) % most, "base": c - c % group})
    heads = sizes.filter(f"conv_id % {group} = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(heads, "base", "left").withColumn("lent", F.least("h", F.coalesce("n_base", _long(0))))
    convs = materialize(convs.withColumn("length", F.col("lent") + F.greatest(F.col("n") - F.col("h"), _long(0))).select("conv_id", "base", "h", "lent", "length"), "convs")
    first = own.filter(f"conv_id % {group} = 0 AND pos < {most - 1}").select(F.col("conv_id").alias("base"), "pos", "token", "words")
    lent = convs.filter("lent > 0").join(first, "base").filter("pos < lent").select("conv_id", (F.col("pos") + 1).alias("depth"), "length", "token", "words")
    kept = own.drop("n").join(convs, "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent") + 1).alias("depth"), "length", "token", "words")
    return materialize(lent.unionByName(kept), "rebuilt"), convs.select("conv_id", "length")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations. Rows without a conv_id belong to none; turns of one number follow in order of a digest of role and text; repeated rows are repeated turns."""
    ordered = turns_in_order(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text"))
    return trie(*rebuild(ordered))


ORACLE = f"""
WITH RECURSIVE own AS (SELECT conv_id, tok, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tok) AS pos FROM (
  SELECT conv_id, turn, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS tok,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, {crc32_of_digits('CAST(conv_id AS VARCHAR)')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own)),
parts AS (SELECT c.conv_id, 0 AS k, pos, tok, words FROM c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, pos, tok, words FROM c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h),
t AS (SELECT conv_id, tok, words, row_number() OVER (PARTITION BY conv_id ORDER BY k, pos) AS depth FROM parts),
p AS (SELECT conv_id, depth, words, sha256(string_agg(tok, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS path,
  coalesce(sha256(string_agg(tok, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), '') AS parent FROM t
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
l AS (SELECT conv_id, max(depth) AS len FROM p GROUP BY conv_id),
v AS (SELECT path, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n, any_value(words) AS words,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = len), '')) AS ends FROM p JOIN l USING (conv_id) GROUP BY path),
k AS (SELECT parent AS path, count(*) AS kids FROM v WHERE parent IS NOT NULL GROUP BY parent),
up AS (SELECT path AS top, path FROM v UNION ALL SELECT v.parent, up.path FROM up JOIN v ON v.path = up.top WHERE v.parent IS NOT NULL),
s AS (SELECT top AS path, CAST(sum((n - 1) * words) AS BIGINT) AS saved, CAST(sum(CASE WHEN kids IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS leaves FROM up JOIN v USING (path) LEFT JOIN k USING (path) GROUP BY top)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(k.kids, 0) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, v.ends AS ends_sha256
FROM v LEFT JOIN v u ON u.path = v.parent LEFT JOIN k ON k.path = v.path JOIN s ON s.path = v.path
"""
