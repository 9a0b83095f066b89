"""The corpus pipeline: quality, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's rows to the shared folder and hands them to the next.

All stages need doc_id, text and source, each of which may be null; a null text
is an empty one. Other columns pass through, whatever their names, but for the
last stage's result columns. Rows that repeat are told apart nowhere: they get
the same verdict, and of equal doc_ids near-duplicate detection keeps one. Texts
of any length are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import bpe, mixing, quality, secrets, simhash
from lodestack.plans.storage import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without boilerplate lines.

    Null and empty texts have no word and go; equal rows stay or go together.
    """
    return quality.clean(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id.

    Texts without a word are near-duplicates of each other. Rows of one doc_id
    are one document; rows without a doc_id belong to no group and stay.
    """
    return simhash.deduplicate(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; ``n_chars`` follows the text.

    Null texts stay null, texts without a secret stay as they are, and no row goes.
    """
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks, shuffled.

    The weight of a source is the square root of its characters; a null source
    is one of its own. Rows of one doc_id come equally often, rows without one
    by their text.
    """
    return mixing.mix(docs).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every copy, after an encode and a decode.

    A null text is empty and has no token; every row gives one.
    """
    vocabulary = bpe.load(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip(docs, vocabulary, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing to target weights", mixing_stage),
    ("byte-level bpe", token_stage),
]

#: XXH64 fingerprints, a random forest and BPE have no form in SQL; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        last = docs
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
        scratch.drop(last)
    return docs
