"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, licenses, media, minhash, packing, quality, sharding, substring_dedup, warc
from .common import Stage


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; operators take it as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).drop("kept_text", "carry")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store(documents(spark, sf_dir)))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(documents(spark, sf_dir), shingle=4, percent=80)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), Stage(spark))).drop("record_bytes")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.refine(documents(spark, sf_dir), digest_all=True)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_media_columns": op2_media_columns,
    "op3_minhash": op3_minhash,
    "op4_license_scan": op4_license_scan,
    "op5_packing": op5_packing,
    "op6_warc": op6_warc,
    "op7_bpe": op7_bpe,
    "op8_sharding": op8_sharding,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op4_license_scan": licenses.scan_sql(),
    "op6_warc": """
        WITH r AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
                          min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM r""",
}
