"""A corpus pipeline of five stages, each over all that its predecessor kept.

Cases, for every stage: rows with nulls in any column, empty or very long texts pass like any other (a null text
is scored, fingerprinted and encoded as the empty one); repeated rows are one near duplicate of each other, of
which one row stays; of near duplicates that with the least id stays, of equal ids that with the least digest; columns beyond those of documents
are kept by all stages but the last, whatever their names; empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.llm import bpe, decontaminate, secret_scan, simhash, toxicity
from kinspark.llm._common import drop_folder, fresh, read_table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted on the labels of those given, doesn't reject; an empty text isn't rejected."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return toxicity.score_documents(docs, model, keep=tuple(docs.columns), name=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link; texts without words are one group."""
    return simhash.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, changed or not."""
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets masked; n_chars is that of the new text, of a null text what it was."""
    return secret_scan.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every text its byte-level token ids, their number, and digests of them and of what they decode to."""
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scans", redact_secrets),
    ("byte_bpe", encode),
]

#: The stages fit classifiers and link components, which SQL can't express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each is written below the shared folder; when the next one is, its folder goes."""
    docs, folder = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before = folder
        docs, folder = written(stage(spark, docs, sf_dir), name)
        if before:
            drop_folder(spark, before)
    return docs
