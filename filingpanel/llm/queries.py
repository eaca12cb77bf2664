"""Registered queries of the package, each over its whole table, with SQL texts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, filter_audit, html_extract, langid, licenses, oracle, packing, pii, prefix_trie, quality, simhash, suffixes, warc
from .common import documents

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), BYTE_BPE, public_tokenizers.PATTERN)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(documents(spark, sf_dir)).select(
        "doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_bundles(warc.mark_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return warc.read_bundles(index, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
SELECT page_id, strlen(p) AS payload_bytes, sha256(p) AS payload_digest,
       CASE WHEN strlen(p) >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(p) >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY p) AS first_id
      FROM (SELECT page_id, coalesce(html, '') AS p FROM pages))
"""


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(pii.BASE_KINDS))
    return found.select(
        "doc_id",
        *[F.size(F.filter(F.col("spans")["kind"], pii.is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.spans_text(base), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir), WORD_BPE)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs)).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(licenses.license_places(documents(spark, sf_dir)))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.cut_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="max")


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""

def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe, "op2_quality": op2_quality, "op3_simhash": op3_simhash, "op4_warc": op4_warc, "op5_pii": op5_pii,
    "op6_packing": op6_packing, "op7_langid": op7_langid, "op8_licenses": op8_licenses, "op9_suffixes": op9_suffixes,
    "op10_exact_dedup": op10_exact_dedup, "op11_html": op11_html, "op12_filter_audit": op12_filter_audit,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {
    "op2_quality": oracle.quality_sql(), "op4_warc": OP4_SQL, "op8_licenses": oracle.licenses_sql(), "op10_exact_dedup": OP10_SQL,
    "op12_filter_audit": oracle.filter_audit_sql(), "op13_prefix_trie": oracle.prefix_trie_sql(),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
