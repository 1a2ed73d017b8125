"""The corpus pipeline: its stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from threatloom.llm import bpe, exact_dedup, language_id, mixing, parity_join
from threatloom.llm.common import documents, written
from threatloom.llm.queries import TOKENIZER

#: Near-duplicate stage: words of a shingle, and least similarity.
SHINGLE_WORDS, AT_LEAST = 5, (4, 5)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the input stay."""
    return language_id.drop_unknown(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    return parity_join.keep_one_of_each(docs, SHINGLE_WORDS, *AT_LEAST)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix(docs, mixing.WEIGHTS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's ids and their digests: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return bpe.round_trip(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written and read again."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs


#: Language ID and encoding have no SQL form; a test compares with brute force.
ORACLE_SQL = None
