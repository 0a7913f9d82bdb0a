"""Documents made ready for training, in five stages. Each reads all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.decontaminate import decontaminate
from gleaner.llm.jaccard import one_of_each
from gleaner.llm.langid import identify
from gleaner.llm.mixing import mix
from gleaner.llm.sharding import shard
from gleaner.llm.store import materialize, table
from gleaner.llm.textsql import WORD, word_count

#: A document is rejected if its language is unknown or less sure than this.
LEAST_SCORE = 0.3


def _hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with neutral column names, so that no extra column's name clashes with an operator's; and the names by column."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def _shown(df: DataFrame, names: dict[str, str], **changed) -> DataFrame:
    return df.select(*[changed.get(c, F.col(n)).alias(c) for c, n in names.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that can be told."""
    rows, at = _hidden(docs)
    told = identify(rows, F.lit(True), carry=list(at.values()), text=at["text"], lang=at["lang"])
    return _shown(told.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), at)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose sets of five-word shingles are linked by similarities of 0.8 or more."""
    rows, at = _hidden(docs)
    return _shown(one_of_each(rows, at["text"], at["doc_id"]), at)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of benchmark items out of the texts; a document of which no word is left goes."""
    rows, at = _hidden(docs)
    clean = decontaminate(rows, table(spark, sf_dir, "benchmark"), carry=list(at.values()), text=at["text"], cut=True)
    changed = {"text": F.col("clean_text")}
    if "n_chars" in at:
        changed["n_chars"] = F.when(F.col("n_hit") > 0, F.length("clean_text").cast("long")).otherwise(F.col(at["n_chars"]))
    return _shown(clean.filter("n_hit = 0 OR n_hit < n_words"), at, **changed)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents: a row for each time that one is taken whole, and its first words where it is taken in part."""
    rows, at = _hidden(docs)
    text = F.col(at["text"])
    mixed = mix(rows.withColumn("n_words", word_count(text)), F.col(at["source"]), [F.col(at["doc_id"]), F.xxhash64(text)], F.col("n_words"))
    whole, rest = F.expr("taken div size"), F.col("taken") % F.col("size")
    times = mixed.filter("taken > 0").withColumn("part", F.explode(F.sequence(F.lit(1), (whole + F.when(rest > 0, 1).otherwise(0)).cast("int"))))
    cut = F.col("part") > whole
    words = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), rest.cast("int")), " ")
    times = times.withColumn("new_text", F.when(cut, words).otherwise(text))
    changed = {"text": F.col("new_text")}
    if "n_chars" in at:
        changed["n_chars"] = F.when(F.col("part") > F.expr("taken div size"), F.length("new_text").cast("long")).otherwise(F.col(at["n_chars"]))
    return _shown(times, at, **changed)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it; these replace columns of such names."""
    rows, at = _hidden(docs)
    text = F.col(at["text"])
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    dealt = shard(rows, text, size, [F.col(at["doc_id"]), F.xxhash64(text)])
    return _shown(dealt, {c: n for c, n in at.items() if c not in ("shard", "slot")} | {"shard": "shard", "slot": "slot"})


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: The first stage learns a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
