"""The corpus pipeline: quality rules, toxicity, near-duplicates, decontamination, tokens.

Each stage gets what the stage before kept and returns the documents that it keeps, with their columns; the last returns
the documents' ids and digests. Rows with null or repeated ids pass through the same stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kestrelqc.cluster import made, settled
from kestrelqc.llm import bpe, decontamination, quality, simhash, toxicity


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; the two multinomials are counted on ``docs``."""
    return quality.keep(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold of toxicity; the model is fitted on labelled rows of ``docs``."""
    return toxicity.keep(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (5-word shingles, similarity 0.8; SimHash chains, then the exact sets)."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=True)


STAGES = [("quality_rules", keep_good), ("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("decontamination", drop_leaks), ("byte_bpe", to_tokens)]

#: Models and alignments are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. Each stage's documents are written; those of the stage before and the tables made on the way are then removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = made()
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), since, name)
    return STAGES[-1][1](spark, docs, sf_dir)
