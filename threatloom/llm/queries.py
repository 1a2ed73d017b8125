"""The thin ``opN_*`` queries over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm import bpe, exact_dedup, html_extract, language_id, mixing, parity_join, personal_data, quality_rules, secrets, token_counts
from threatloom.llm.common import deleted, documents, shared_dir, written
from threatloom.sources.tables import table

#: The tokenizer of the queries, and its id that ends documents in token files.
TOKENIZER, END_OF_TEXT = "word_bpe_49k.json", 49407


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(documents(spark, sf_dir))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.jaccard_classes(documents(spark, sf_dir), parity_join.SHINGLE_WORDS, *parity_join.AT_LEAST)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from token files written in the shared folder."""
    where = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    counts = written(token_counts.document_counts(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), END_OF_TEXT, where), "token-counts")
    deleted(spark, where)
    return counts


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("_id"), (1 - F.col("quality")).alias("_bad"))
    return quality_rules.apply_rules(documents(spark, sf_dir), labels)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir), mixing.WEIGHTS)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_personal_data": op3_personal_data,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_token_counts": op5_token_counts,
    "op6_quality_rules": op6_quality_rules,
    "op7_mixing": op7_mixing,
    "op8_bpe": op8_bpe,
    "op9_html_extract": op9_html_extract,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op4_ngram_jaccard": parity_join.ORACLE_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
}
