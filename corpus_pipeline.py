"""From raw documents to token ids: quality, near duplicates, mixing, encoding.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents that it keeps, with
their columns, the last one the token ids. ``run`` applies them to the documents of ``sf_dir``, each stage's
result written to the shared folder as Parquet and read again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, mixing, near_dedup, quality
from quarry.llm.common import materialize, read
from quarry.session import ship_package

TOKENIZER = "word_bpe_49k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field, fitted to the labels, does not reject."""
    ship_package(spark)
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets agree to 80 % or more."""
    ship_package(spark)
    return near_dedup.deduplicate(docs, k=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    ship_package(spark)
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of the decoded text."""
    ship_package(spark)
    return bpe.bpe_encode(docs, public_tokenizers.path(TOKENIZER), with_ids=True).drop("decoded")


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: The stages' models and hashes can't be written as SQL; tests/llm checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
