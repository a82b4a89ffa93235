"""Corpus pipeline: a chain of operators over ``documents``, each stage written and read again.

Each stage works on all rows that the one before it kept.  All but the last return the columns of
``documents``; the last returns the ids of the texts that are left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from areaindex.llm import byte_bpe, decontaminate, language_id, near_dedup, suffix_dedup
from areaindex.llm.common import documents, land


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go."""
    return language_id.keep_known_languages(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.remove_near_duplicates(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that are repeated anywhere are cut out of the texts; every document stays."""
    return suffix_dedup.remove_repeats(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return decontaminate.remove_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids of every text and of the bytes they decode to."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encoding_digests(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("encode", encode_stage),
]

#: Byte-level matching, language models and subword ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order; each one's rows are written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), name)
    return docs
