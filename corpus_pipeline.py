"""Corpus pipeline: quality classifier, exact dedup, SimHash near-dedup, benchmark
decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs.  All but the last return the columns of documents.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vecsync.llm import bpe, crf, decontam, exact_dedup, simhash
from vecsync.llm.common import documents, materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier scores at 0.3 or more."""
    field = crf.learn(docs, documents(spark, sf_dir, "labels"), ~crf.held_out())
    return crf.keep_good(docs, field, 0.3)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every text (equal after lower-casing A-Z): the largest doc_id."""
    return exact_dedup.deduplicate(docs, keep="max")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group: the smallest doc_id."""
    return simhash.deduplicate(docs, shingle=4, radius=4)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover under 0.8 of every benchmark item."""
    return decontam.decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN)


STAGES = [("quality_classifier", quality_stage), ("exact_dedup", exact_stage),
          ("simhash_near_dedup", simhash_stage),
          ("benchmark_decontamination", decontamination_stage), ("byte_bpe", bpe_stage)]

#: SQL has no XXH64, no conditional random field and no byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written and read again before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
