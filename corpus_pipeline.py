"""Corpus pipeline: quality filter, near-dedup, benchmark decontamination, mixing to target weights, sharding.

Every stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps with all their columns; the last adds
the shard of each. ``run`` writes each stage's result as Parquet in the cluster's shared folder and rereads it, so a
lost executor costs at most the stage at work; a stage's result is deleted once the next one's is written.

Rows with a null id are scored, scanned, mixed and sharded like any other; near-dedup, which names documents by their
id, keeps them. Rows repeated with one id are one document to near-dedup. Extra columns pass through
unread, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontaminate, knn_quality, minhash_dedup, mixing, sharding
from lectern.llm.common import delete, shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour classifier accepts."""
    return knn_quality.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each near-duplicate class."""
    return minhash_dedup.keep(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target asks for."""
    return mixing.take(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard."""
    return sharding.shard(docs, columns=tuple(c for c in docs.columns if c not in ("doc_id", *sharding.ADDED)))


STAGES = [("quality_classifier", quality), ("minhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]

#: The first two stages are learned and probabilistic: SQL cannot express them, so tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            delete(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
