"""The corpus pipeline: documents to sharded training documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; its result is written as Parquet and
read again as the next stage's input. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from replenish.llm import decontaminate, mixing, quality, shards, simhash
from replenish.llm.tables import read
from replenish.session import scratch_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By op2's radius: near copies from similarity 0.8 on that differ in more than four bits all stay."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come as often as the mix takes them."""
    return mixing.apply(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with slot, shard and shard_name."""
    return shards.place(docs, shards.shard_names())


STAGES = [
    ("quality rules", good_documents),
    ("simhash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("source mix", mixed),
    ("sharding", sharded),
]

# fingerprint groups and template alignments are not for SQL; tests hold the rows against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
