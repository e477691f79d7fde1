"""The corpus pipeline: each stage gets what the one before kept and is written as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from holdfast.llm.common import stored, table
from holdfast.llm.queries import vocabulary


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return toxicity.remove(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each different text, the one of the smallest id."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that n-gram Jaccard links of 0.8 connect, the one of the smallest id."""
    return jaccard_join.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of smaller sources up to 1.5 times on average."""
    return mixing.mixed(docs, MIX)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, as digests."""
    return bpe.encode_digests(docs, vocabulary())


MIX = mixing.Mix(entropy=0.95, passes=1.5, budget=None)

STAGES = [("toxicity", toxic), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mixed), ("bpe", encoded)]

#: A trained model, MinHash and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
