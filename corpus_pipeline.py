"""Training-text pipeline: filter, near-dedup, decontaminate, mix, shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from srcatlas.llm.common import stored, table
from srcatlas.llm.decontamination import decontaminate
from srcatlas.llm.mixing import mixed_documents
from srcatlas.llm.quality import good_documents
from srcatlas.llm.sharding import SHARDS, sharded_documents
from srcatlas.llm.simhash import without_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; empty and null texts are judged like any other."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last of a source may be cut. Documents without words go."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the columns shard and slot."""
    return sharded_documents(docs, SHARDS, whole=0.1)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing),
          ("sharding", sharding)]

# Neither the classifier nor the fingerprints can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written once and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
