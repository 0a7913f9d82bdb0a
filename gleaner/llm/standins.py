"""Queries over what SQL can say of operators that it can't say whole, and over data where a rule decides that decides nothing on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .host_rules import BAD_HOST_ORACLE, bad_host_documents
from .mixing import mix_documents
from .store import table
from .url_filter import RULES, filter_pages

_PARTS = "'(?s)^.*?://([^/?#]*)([^?#]*)'"
_RULED = "\n".join(
    f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND path LIKE '/{p}%' THEN '{r}'" for r, _ in sorted(RULES, key=lambda x: -len(x[0])) for h, _, p in [r.partition("/")]
)
_VERDICTS = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES)

URL_RULES = f"""
SELECT page_id, host, path, rule, CASE rule {_VERDICTS} END AS verdict FROM (SELECT page_id, host, path, CASE {_RULED} END AS rule FROM (
SELECT page_id, translate(regexp_extract(u, {_PARTS}, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(u, {_PARTS}, 2) AS path
FROM (SELECT page_id, coalesce(url, '') AS u FROM pages)))
"""

MIX_TARGETS = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT source, z, CASE (i - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w, 3.0 * z AS most FROM s),
o AS (SELECT source, z, w, most, row_number() OVER (ORDER BY most / w, source NULLS LAST) AS k FROM w),
l AS (SELECT k, most / w AS ratio, ((SELECT sum(z) FROM s) - (SELECT coalesce(sum(b.most), 0) FROM o b WHERE b.k < a.k)) / (SELECT sum(b.w) FROM o b WHERE b.k >= a.k) AS level FROM o a),
t AS (SELECT coalesce(min(level), 1e300) AS level FROM l WHERE k = (SELECT min(k) FROM l WHERE level <= ratio))
SELECT doc_id, size, z AS source_size, round(least(most, level * w), 4) AS target FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source, t
"""

QUERIES = {
    "url_rules": lambda spark, d: filter_pages(table(spark, d, "pages")).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict")),
    "mix_targets": lambda spark, d: mix_documents(table(spark, d, "documents")).select("doc_id", "size", "source_size", F.round("target", 4).alias("target")),
    "bad_host": lambda spark, d: bad_host_documents(table(spark, d, "documents")),
}
ORACLES = {"url_rules": URL_RULES, "mix_targets": MIX_TARGETS, "bad_host": BAD_HOST_ORACLE}
