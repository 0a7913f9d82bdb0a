"""The training-data operators over their whole tables."""

from __future__ import annotations

from . import decontaminate, host_rules, jaccard, merkle, prefix_free, simhash, standins, suffix_tree, trie
from .decontaminate import check_documents
from .host_rules import quality_documents
from .jaccard import join_documents
from .langid import identify_documents
from .mixing import mix_documents
from .sharding import shard_documents
from .store import table
from .toxicity import toxicity_documents
from .url_filter import filter_pages

QUERIES = {
    "op1_url_filter": lambda spark, d: filter_pages(table(spark, d, "pages")),
    "op2_sharding": lambda spark, d: shard_documents(table(spark, d, "documents")),
    "op3_decontamination": lambda spark, d: check_documents(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op4_langid": lambda spark, d: identify_documents(table(spark, d, "documents")),
    "op5_jaccard_join": lambda spark, d: join_documents(table(spark, d, "documents")),
    "op6_suffix_tree": lambda spark, d: suffix_tree.dedup_documents(table(spark, d, "documents")),
    "op7_host_rules": lambda spark, d: quality_documents(table(spark, d, "documents")),
    "op8_toxicity": lambda spark, d: toxicity_documents(table(spark, d, "documents"), table(spark, d, "labels")),
    "op9_prefix_free": lambda spark, d: prefix_free.dedup_documents(table(spark, d, "documents")),
    "op10_mixing": lambda spark, d: mix_documents(table(spark, d, "documents")),
    "op11_merkle_manifest": lambda spark, d: merkle.check_documents(table(spark, d, "documents")),
    "op12_prefix_trie": lambda spark, d: trie.conversation_trie(table(spark, d, "conversations")),
    "op13_simhash": lambda spark, d: simhash.fingerprint_documents(table(spark, d, "documents")),
    **standins.QUERIES,
}

ORACLES: dict[str, str] = {
    "op3_decontamination": decontaminate.ORACLE,
    "op5_jaccard_join": jaccard.ORACLE,
    "op6_suffix_tree": suffix_tree.ORACLE,
    "op7_host_rules": host_rules.ORACLE,
    "op9_prefix_free": prefix_free.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_prefix_trie": trie.ORACLE,
    "op13_simhash": simhash.ORACLE,
    **standins.ORACLES,
}
