"""From raw documents to packed sequences: each stage works on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import contextual_pii, minhash, packing, quality, suffix_dedup
from shelfwise.llm.storage import dropping_stored, new_path, written

#: About fifty short words: a passage of more than fifty words is longer in any language.
PASSAGE_BYTES = 200


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.drop_near_duplicates(docs)


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars says how long the text is now."""
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return docs if length is None else docs.withColumn("n_chars", length)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur twice or more are cut out everywhere; the documents stay."""
    return _counted(suffix_dedup.cut_repeats(docs, suffix_dedup.Repeats(PASSAGE_BYTES)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets."""
    return _counted(contextual_pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packed", packed),
]

#: Tokens can't be had in SQL; the tests hold the pipeline against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of `documents`. Between stages the documents are a Parquet table in the shared folder; what
    a stage stores on its way is dropped as soon as its documents are written.

    Null and empty texts fail the quality rules; of repeated rows and ties the near-duplicate stage keeps the smallest
    id; texts of any length are read whole; further columns go along until packing. An empty table gives an empty one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with dropping_stored(spark):
            docs = written(stage(spark, docs, sf_dir), new_path(spark, name))
