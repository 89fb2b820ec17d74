"""A corpus pipeline of five operators: each stage works on all that its predecessor kept, from Parquet to Parquet.

Defined cases: a null text counts as empty in every stage (quality scores it, it is near nothing but empty texts, holds no benchmark item,
has size 0 for the mix, and is the end id alone in the store); equal rows are one document after near-dedup, whatever their ids; a document
that the mix takes more than once comes as often to the store; columns that documents have besides their own are carried as far as the mix;
an empty table gives an empty result. Each stage's table is removed when the next one's is whole; the last one's is the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import castore, decontam, mixing, probmin, quality
from docloom.llm.common import label_bucket, remove, shared_path, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts. It learns from the labels of rows that aren't held out."""
    labels = table(spark, sf_dir, "labels")
    return quality.keep_good(docs, labels.where(label_bucket("doc_id") != 0))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least id."""
    return probmin.keep_one(docs)


def untainted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix to target weights takes them."""
    return mixing.mixed(docs)


def stored(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids in the content-addressed store, read back: place, number and crc32."""
    return castore.stored(docs)


STAGES = [("quality", good), ("near_dedup", distinct), ("decontamination", untainted), ("mixing", mixed), ("token_store", stored)]

#: A trained classifier and hashed signatures are not expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(last, spark)
        last = path
    return docs
