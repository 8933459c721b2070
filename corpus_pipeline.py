"""A training-data pipeline over ``documents``: five stages, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir), docs with the columns of ``documents``, and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm import bpe, decontam, lines, neardup, quality
from photonlake.llm.common import table
from photonlake.plans.shared import settled

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labelled ones, doesn't reject (score of 0.3 or more)."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated runs; n_chars follows the text. One that was all repetition goes."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out, deleted = lines.dedup_lines(docs, keep=others), F.col(lines.new_names(others)[1])
    left = out.where((deleted == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(deleted > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*(f"`{c}`" for c in docs.columns))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each near-duplicate group (five-word shingles, 0.8 or more)."""
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the bytes they decode to."""
    return bpe.encode_column(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", lines_stage),
    ("near-duplicates", neardup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", bpe_stage),
]

#: The classifier is no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; the tables that a stage wrote on its way go when its result stands."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
