"""The corpus pipeline: rejects bad texts, drops near duplicates, masks personal data, mixes sources and encodes.

Every stage takes nulls in any column, empty and very long texts, repeated ids and rows, ties,
empty tables (which give empty ones) and further columns whose names clash, also in case only;
these are left out, as all stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from linkhop.llm.bpe import bpe_digests
from linkhop.llm.common import written
from linkhop.llm.mixing import mix
from linkhop.llm.ngram_join import one_of_each
from linkhop.llm.pii import pii_masked
from linkhop.llm.quality import quality_filter

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier rejects go; a null text is judged as an empty one, equal texts alike.  Without a positive label all rows stay."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near duplicates stays: the one with the smallest id, null ids last, of equal rows one.  Texts without words (null and empty ones too) are no duplicates and stay."""
    return one_of_each(docs).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; n_chars is that of the masked text, and null where it was null.  All rows stay; a null text stays null."""
    masked = pii_masked(docs)
    return masked.withColumn("n_chars", F.when(masked["n_chars"].isNotNull(), F.length("text").cast("long"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights; a text that is taken twice is two rows.  A null source is one of its own; rows equal in id and text share their fate."""
    return mix(docs).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each text and the digests of ids and decoded text, one row a row; a null text counts as empty."""
    return bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: A trained classifier and the merges of a tokenizer are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
