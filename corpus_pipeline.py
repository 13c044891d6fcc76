"""The corpus pipeline: five stages over ``documents``, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``documents``; the
last returns the encoded mixture. ``run`` writes each stage as Parquet in the shared checkpoint folder
and reads it again for the next, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.bpe import bpe_encode
from tickloom.llm.line_dedup import drop_repeated_lines
from tickloom.llm.mixing import apply_mix
from tickloom.llm.near_dedup import without_near_duplicates
from tickloom.llm.quality_rules import good_documents
from tickloom.llm.runtime import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return good_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more have go."""
    return drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: words of five, similarity 0.8."""
    return without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to weights 1, 2, 3 in turn: documents are repeated, cut or left out."""
    return apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids for each text of the mixture."""
    return bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near_duplicates), ("mixing", mix), ("encoding", encode)]

#: SQL cannot express the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
