"""The registered queries of the operators: production parameters, whole tables, digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import secrets
from .bpe import bpe_encode
from .html_extract import extract_text
from .langid import identify, learn
from .media import media_columns
from .minhash import near_duplicates
from .mixing import mix
from .oracles import ORACLES as ORACLES
from .quality import quality
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def vocabulary() -> str:
    """The installed vocabulary file, found anew on each machine."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_read(spark, sf_dir, "documents", "doc_id", "text"), keep_text=False)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan_secrets(_read(spark, sf_dir, "documents", "doc_id", "text"), path="doc_id").drop("text"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(_read(spark, sf_dir, "documents", "doc_id", "text"), vocabulary, public_tokenizers.PATTERN, keep_ids=False)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_read(spark, sf_dir, "documents", "doc_id", "text"), keep_text=False)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(_read(spark, sf_dir, "documents", "doc_id", "text"), keep_media=False)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return identify(docs, learn(docs))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text")).drop("content")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_read(spark, sf_dir, "documents", "doc_id", "text")).drop("rejected_by")


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_secret_scan, op3_bpe, op4_suffix_dedup, op5_media,
        op6_language_id, op7_source_mix, op8_near_duplicates, op9_html_text, op10_quality_rules,
    )
}
