"""The corpus pipeline: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's rows to the shared folder and hands what it reads back to the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import near_duplicates, packing, quality, runtime, substrings, surrogates
from docquarry.llm.registry import SURROGATE_KEY


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word rules and the perplexity bands accept. Null and empty texts go."""
    return quality.accepted(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked by five-word shingles at 0.8 or more."""
    return near_duplicates.deduplicated(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of twenty words that an earlier document or place has. All rows stay."""
    return substrings.cleaned(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data. All rows stay."""
    return surrogates.cleaned(docs, SURROGATE_KEY)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents' tokens, packed into sequences of 1024."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, keep_ids=False).drop("ids")


STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", drop_near_copies),
    ("repeated passages", drop_repeated_passages),
    ("personal data", replace_personal_data),
    ("packing", pack_sequences),
]

#: Perplexities and tokenisers can't be had in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = runtime.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
