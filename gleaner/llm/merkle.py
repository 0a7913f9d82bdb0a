"""A Merkle manifest of a dataset: a tree for each source, a tree over the sources' roots, and proofs from parents' preimages.

A parent keeps its preimage, the digests of its children one after the other. A leaf that has its ancestors' preimages has its proof: what is left of each when the 64
characters of its own path are taken out; and put back in their place, another digest gives the root that it would make.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered
from .sqlbits import crc32_of_digits
from .store import materialize
from .textsql import lower_ascii

#: Children of a node, and characters of a digest.
FAN, DIGEST = 16, 64


def field(c: Column) -> Column:
    """A value as it enters a digest: bytes, colon, value; `-` for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def siblings(steps: Column) -> Column:
    """Digests beside a path, level by level: each preimage without the path's own digest."""
    rest = F.transform(steps, lambda s: F.concat(F.substring(s["pre"], F.lit(1), s["slot"] * DIGEST), F.substring(s["pre"], s["slot"] * DIGEST + DIGEST + 1, F.length(s["pre"]))))
    return F.array_join(rest, "")


def fold(digest: Column, steps: Column) -> Column:
    """The root that a digest makes at the end of a path, with the siblings that the path has."""

    def up(h: Column, s: Column) -> Column:
        return F.sha2(F.concat(F.substring(s["pre"], F.lit(1), s["slot"] * DIGEST), h, F.substring(s["pre"], s["slot"] * DIGEST + DIGEST + 1, F.length(s["pre"]))), 256)

    return F.aggregate(steps, digest, up)


def forest(leaves: DataFrame, order: Sequence[Column], name: str) -> list[DataFrame]:
    """Levels of a tree for each value of `tree`, from the runs of leaves up.

    leaves: tree (without nulls), hash, and columns that stay with the leaf. A level's rows are nodes: tree, pos, n (nodes of the tree in that level), pre, hash; the first
    level's also have kids (hash and the other columns of the leaves, in order) and leaves. A tree of one leaf has it as its root, and pre is null.
    """
    carried = [c for c in leaves.columns if c not in ("tree", "hash")]
    run, above = F.expr(f"pos div {FAN}"), F.expr(f"(n + {FAN - 1}) div {FAN}")
    kids = F.sort_array(F.collect_list(F.struct("pos", "hash", *carried)))
    first = numbered(leaves, "tree", order, name).groupBy("tree", run.alias("pos")).agg(kids.alias("kids"), F.max("n").alias("leaves"))
    pre = F.when(F.col("leaves") > 1, F.array_join(F.transform("kids", lambda k: k["hash"]), ""))
    first = first.withColumn("pre", pre).withColumn("hash", F.coalesce(F.sha2("pre", 256), F.element_at("kids", 1)["hash"])).withColumn("n", F.expr(f"(leaves + {FAN - 1}) div {FAN}"))
    levels = [materialize(first, name)]
    nodes = levels[0].agg(F.max("n")).first()[0] or 0
    while nodes > 1:
        grown = levels[-1].filter("n > 1").groupBy("tree", run.alias("pos")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "hash"))), lambda k: k["hash"]), "").alias("pre"), F.max(above).alias("n"))
        levels.append(materialize(grown.withColumn("hash", F.sha2("pre", 256)), name))
        nodes = -(-nodes // FAN)
    return levels


def roots(levels: Sequence[DataFrame]) -> DataFrame:
    """tree and hash of every tree's root."""
    tops = [x.filter("n = 1").select("tree", "hash") for x in levels]
    out = tops[0]
    for x in tops[1:]:
        out = out.unionByName(x)
    return out


def paths(levels: Sequence[DataFrame], beyond: DataFrame | None = None) -> DataFrame:
    """The leaves of a forest, each with tree, kid (the leaf) and steps, its way to the root: preimage and slot of each ancestor.

    beyond: tree and steps from a tree's root on, where the trees hang in another one.
    """
    slot = lambda c: (c % FAN).cast("int").alias("slot")
    none = F.expr("CAST(array() AS array<struct<pre: string, slot: int>>)")
    above = None
    for level in reversed(levels):
        top = level.filter("n = 1")
        now = top.withColumn("steps", none) if beyond is None else top.join(beyond, "tree")
        if above is not None:
            parent = above.select("tree", F.col("pos").alias("__up"), F.col("pre").alias("__pre"), F.col("steps").alias("__steps"))
            inner = level.filter("n > 1").withColumn("__up", F.expr(f"pos div {FAN}")).join(parent, ["tree", "__up"])
            now = now.unionByName(inner.withColumn("steps", F.concat(F.array(F.struct(F.col("__pre").alias("pre"), slot(F.col("pos")))), "__steps")).drop("__up", "__pre", "__steps"))
        above = now
    each = above.select("tree", F.explode("kids").alias("kid"), "leaves", "pre", "steps")
    own = F.concat(F.array(F.struct("pre", slot(F.col("kid.pos")))), "steps")
    return each.select("tree", "kid", F.when(F.col("leaves") > 1, own).otherwise(F.col("steps")).alias("steps"))


def manifest(leaves: DataFrame, source: Column, order: Sequence[Column]) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels of the sources' trees, and of the tree over their roots.

    leaves: hash, and columns that stay with the leaf. A null source comes first, the others follow by their UTF-8 bytes. order: of a source's leaves; leaves that tie
    go on by their digest, and rows that tie in that too are interchangeable. An empty table has empty levels.
    """
    key = F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))
    own = forest(leaves.withColumn("tree", key), [*order, F.col("hash").asc()], "leaves")
    over = roots(own).select(F.lit(0).alias("tree"), F.col("tree").alias("source_tree"), "hash")
    return own, forest(over, [F.col("source_tree").asc()], "sources")


def proofs(leaves: DataFrame, source: Column, order: Sequence[Column]) -> DataFrame:
    """manifest() as one row for each leaf: kid (the leaf), subroot, root and steps."""
    own, over = manifest(leaves, source, order)
    top = roots(over).first()  # the one digest
    hung = paths(over).select(F.col("kid.source_tree").alias("tree"), F.col("kid.hash").alias("subroot"), "steps", F.lit(top["hash"] if top else None).cast("string").alias("root"))
    hung = materialize(hung, "subroots")
    return paths(own, hung.select("tree", "steps")).join(hung.select("tree", "subroot", "root"), "tree")


def check_documents(docs: DataFrame) -> DataFrame:
    """Every row of documents with its digests and its proof's, and the root that comes of it after tampering.

    Null values are `-`; rows of one source and doc_id stand in order of their digests, null ids first; equal rows each have a place of their own. A null or plain text, and
    a row whose id is null, are as before after tampering, and verified."""
    cells = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select("doc_id", "source", leaf(*cells, F.col("text")).alias("hash"), F.when(hit, leaf(*cells, lower_ascii(F.col("text")))).alias("tampered"))
    found = proofs(rows, F.col("source"), [F.col("doc_id").asc_nulls_first()])
    back = fold(F.coalesce("kid.tampered", "kid.hash"), F.col("steps"))
    out = found.select(F.col("kid.doc_id").alias("doc_id"), F.col("kid.hash").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("steps")), 256).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_LEVELS, _OVER = 5, 3  # of the SQL: 16**5 leaves of a source, 16**3 sources
_CELLS = "doc_id source lang n_chars".split()


def _leaf_sql(text: str) -> str:
    cell = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(cell.format(c) for c in [*_CELLS, text]) + ")"


def _climb(first: str, levels: int, name: str) -> str:
    """Nodes by level: {name}0 is `first` (tree, pos, n, h); a tree of one node stays as it is."""
    out = [f"{name}0 AS ({first})"]
    for k in range(1, levels + 1):
        out.append(
            f"{name}{k} AS (SELECT tree, pos // {FAN} AS pos, (n + {FAN - 1}) // {FAN} AS n, string_agg(h, '' ORDER BY pos) AS pre, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h "
            f"FROM {name}{k - 1} GROUP BY tree, pos // {FAN}, n)"
        )
    return ",\n".join(out)


def _way(name: str, levels: int, start: str, h: str, beside: str) -> str:
    """Tables that carry h and beside from `start` (with tree, pos and n of its first level) up level by level."""
    out, now = [], start
    for k in range(1, levels + 1):
        left, right = f"left(p.pre, {DIGEST} * (w.pos % {FAN}))", f"substr(p.pre, {DIGEST} * (w.pos % {FAN}) + {DIGEST + 1})"
        out.append(
            f"{name}{k} AS (SELECT w.* EXCLUDE (pos, n, {h}, {beside}), w.pos // {FAN} AS pos, p.n AS n, CASE WHEN w.n > 1 THEN sha256({left} || w.{h} || {right}) ELSE w.{h} END AS {h}, "
            f"CASE WHEN w.n > 1 THEN w.{beside} || {left} || {right} ELSE w.{beside} END AS {beside} FROM {now} w JOIN {beside}_{k} p ON p.tree = w.tree AND p.pos = w.pos // {FAN})"
        )
        now = f"{name}{k}"
    return ",\n".join(out)


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf_sql('text')} AS leaf,
CASE WHEN {crc32_of_digits('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_climb('SELECT tree, pos, n, leaf AS h FROM l', _LEVELS, 'own_')},
{_climb(f"SELECT 0 AS tree, tree AS source, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, h FROM own_{_LEVELS}", _OVER, 'over_')},
w0 AS (SELECT doc_id, tree, pos, n, leaf, coalesce(tampered, leaf) AS fold, '' AS own FROM l),
{_way('w', _LEVELS, 'w0', 'fold', 'own')},
v0 AS (SELECT w.doc_id, w.leaf, w.fold, w.own AS over, o.h AS subroot, o.tree, o.pos, o.n FROM w{_LEVELS} w JOIN over_0 o ON o.source = w.tree),
{_way('v', _OVER, 'v0', 'fold', 'over')}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(over) AS proof_sha256, fold AS folded_root, fold = r.h AS verified FROM v{_OVER} v, over_{_OVER} r
"""
