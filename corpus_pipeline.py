"""Corpus pipeline: five stages over ``documents``, each one operator of ``colstrata.llm`` over all that is left.

Quality and toxicity by the weak-label scorer, one document of each group of near-duplicates (SimHash tiles, checked on
whole shingle sets), no document with a benchmark passage, sources mixed to their weights (documents repeat as often as the mix takes them), and shards by a k-d tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colstrata.llm import decontaminate, mixing, quality, sharding, simhash
from colstrata.llm._shared import durable, mark, sweep


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group of near-duplicates (five-word shingles, similarity 0.8).

    The similarity is the one that SimHash estimates, the cosine of the shingle sets; every link is checked exactly.
    """
    return simhash.near_dedup(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no whole benchmark window of 13 words occurs."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row: (doc_id, size, text_crc32, shard, slot)."""
    return sharding.shards(docs, 24)


STAGES = [("quality", good), ("near_dedup", distinct), ("decontaminate", clean), ("mix", mixed), ("shard", sharded)]

#: The rounding draws, the fingerprints' groups and the fitted scorer have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every other stage's rows are written, and what it made on the way is deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = mark()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs, name)
            sweep(since, docs)
    return docs
