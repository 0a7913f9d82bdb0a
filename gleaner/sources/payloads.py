"""Batch, CV and letter payloads from JSON files, one payload a file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S


def raw_payloads(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, raw): whole files."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def _files(value: Column) -> Column:
    """An object of labels and paths as an array in the order of the text."""
    made = F.from_json(value, "map<string,string>")
    return F.transform(F.map_entries(made), lambda e: F.struct(e["key"].alias("label"), e["value"].alias("path")))


def parse_batch(raw: DataFrame, default_date: str | None = None) -> DataFrame:
    """Columns of the batch schema, and corrupt where the text is no object. The date is filled in only where the key is missing."""
    role = "struct<rank:int,company:string,title:string,location:string,url:string,why:string,flags:array<string>,files:string>"
    kind = f"date string, pool_size bigint, note string, built array<{role}>, dropped array<struct<company:string,title:string,reason:string>>"
    b = raw.withColumn("__b", F.from_json("raw", kind, {"mode": "PERMISSIVE"}))
    has_date = F.array_contains(F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>")), "date")
    built = F.transform("__b.built", lambda r: F.struct(*[r[c].alias(c) for c in ("rank", "company", "title", "location", "url", "why", "flags")], _files(r["files"]).alias("files")))
    return b.select(
        *[c for c in raw.columns if c != "raw"],
        F.when(has_date, F.col("__b.date")).otherwise(F.lit(default_date)).alias("date"),
        F.col("__b.pool_size").alias("pool_size"), F.coalesce("__b.note", F.lit("")).alias("note"),
        F.coalesce(built, F.array().cast(S.ROLES)).alias("built"),
        F.coalesce("__b.dropped", F.array().cast(S.DROPPED)).alias("dropped"),
        F.json_object_keys("raw").isNull().alias("corrupt"),
    )


def parse_cv(raw: DataFrame) -> DataFrame:
    """Columns of the CV schema, missing (required keys that are absent) and corrupt.

    A section's items are pairs where its type is skills and structs otherwise, so both readings of
    the variant are kept, each where it fits.
    """
    v = raw.withColumn("__v", F.try_parse_json("raw"))
    get = lambda path, kind: F.try_variant_get("__v", path, kind)
    sections = F.transform(
        get("$.sections", "array<variant>"),
        lambda s: F.struct(
            F.try_variant_get(s, "$.type", "string").alias("type"), F.try_variant_get(s, "$.title", "string").alias("title"),
            F.when(F.try_variant_get(s, "$.type", "string") != "skills", F.try_variant_get(s, "$.items", f"array<{S.ITEM}>")).alias("items"),
            F.when(
                F.try_variant_get(s, "$.type", "string") == "skills",
                F.transform(F.try_variant_get(s, "$.items", "array<array<string>>"), lambda p: F.struct(F.get(p, 0).alias("label"), F.get(p, 1).alias("value"))),
            ).alias("skills"),
        ),
    )
    return v.select(
        *[c for c in raw.columns if c != "raw"], get("$.name", "string").alias("name"), get("$.tagline", "string").alias("tagline"),
        F.coalesce(get("$.contact", "array<string>"), F.array().cast("array<string>")).alias("contact"), get("$.summary", "string").alias("summary"),
        sections.cast(S.SECTIONS).alias("sections"), _missing("raw", "cv").alias("missing"), F.col("__v").isNull().alias("corrupt"),
    )


def parse_letter(raw: DataFrame) -> DataFrame:
    rows = raw.withColumn("__l", F.from_json("raw", S.LETTER))
    return rows.select(*[c for c in raw.columns if c != "raw"], "__l.*", _missing("raw", "letter").alias("missing"), F.json_object_keys("raw").isNull().alias("corrupt"))


def _missing(raw: str, kind: str) -> Column:
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    return F.array_except(F.array(*[F.lit(k) for k in S.REQUIRED[kind]]), keys)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table; without rows where there is none yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
