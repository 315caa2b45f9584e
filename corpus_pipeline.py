"""The corpus pipeline: toxicity, near duplicates, personal data, mixture and packing, each stage on what is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.llm import mixing, packing, pii, sigtree, toxicity
from plantlens.llm.common import stage_table, word_count


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays."""
    return sigtree.keep_one(docs)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts, and n_chars follows."""
    masked = pii.mask_documents(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mixture takes them, shard by shard."""
    return mixing.mix_documents(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in a batch."""
    return packing.pack(docs, word_count(F.col("text")))


STAGES = [("toxicity", drop_toxic), ("near-duplicates", drop_copies), ("personal-data", mask_private), ("mixture", mix_sources), ("packing", pack_batches)]

#: SQL has no counterpart of training, signature trees or the splitting tree; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage_table(docs, f"pipeline-{name}")
    return docs
