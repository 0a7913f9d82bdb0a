"""Explicit schemas, as DDL. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(ddl: str) -> T.StructType:
    """The schema as a type; this needs a session."""
    return T.StructType.fromDDL(ddl)


SIGHTING = "title string, company string, location string, url string, source string, query string, description string, seq bigint, page_no int, pos int"
POSTING = "key string, title string, company string, location string, url string, source string, query string, description string, seq bigint, first_seq bigint"
RUN_STATE = "total int, remaining int, with_descriptions boolean, collected int, started_at bigint"
MARK_EVENT = "batch_date string, url string, kind string, checked boolean, seq bigint"
APPLIED = "url string, first_seq bigint"
SAVED_SEARCH = "kw string, loc string, radius int, site string, posted int, remote boolean"
STATUS = "applied bigint, collected_today bigint, built bigint, latest_batch string, latest_report string, last_rank struct<matches:bigint>"
LAST_PUSH = "seq bigint, sent bigint, added bigint"
BUILT = "key string, date string, rank int, company string"
ROLES = "array<struct<rank:int,company:string,title:string,location:string,url:string,why:string,flags:array<string>,files:array<struct<label:string,path:string>>>>"
DROPPED = "array<struct<company:string,title:string,reason:string>>"
BATCH = f"date string, pool_size bigint, note string, built {ROLES}, dropped {DROPPED}"
LETTER = "sender array<string>, date string, recipient array<string>, subject string, salutation string, paragraphs array<string>, closing string, signature string"
ITEM = "struct<role:string,org:string,meta:string,bullets:array<string>>"
SECTIONS = f"array<struct<type:string,title:string,items:array<{ITEM}>,skills:array<struct<label:string,value:string>>>>"
CV = f"name string, tagline string, contact array<string>, summary string, sections {SECTIONS}"
REQUIRED = {
    "cv": ("name", "sections"),
    "letter": ("sender", "date", "recipient", "subject", "salutation", "paragraphs", "closing", "signature"),
}
