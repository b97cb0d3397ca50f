"""The queries of the training-data operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kinspark.llm import bpe, decontaminate, language_id, media, page_text, secret_scan, simhash, sql, sstable, toxicity, url_filter
from kinspark.llm._common import read_table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_digests(read_table(spark, sf_dir, "documents"))


def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_text(read_table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(read_table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_digests(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.shard_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_page_text, op3_decontaminate, op4_media_columns, op5_byte_bpe, op6_simhash, op7_sstable, op8_language_id, op9_toxicity, op10_url_filter, pipeline)}


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express; tests hold the others against plain versions, round trips or held-out rows."""
    return {"op1_secret_scan": sql.secret_scan_sql(), "op10_url_filter": sql.url_filter_sql()}
