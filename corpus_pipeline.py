"""A corpus pipeline: quality rules, three kinds of deduplication, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last give the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestream.llm import exact_dedup, packing, quality, simhash, suffix_dedup
from lodestream.llm.common import scratch, written
from lodestream.llm.entries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the classifier is trained on the labelled among ``docs``."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    index = exact_dedup.DigestIndex(spark, f"pipeline_digests_{uuid.uuid4().hex}")
    try:
        return exact_dedup.drop_copies(index, docs)
    finally:
        index.drop()  # this run's corpus alone; one that grows keeps its index by name


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles alike by 0.8 or more) the document with the least id."""
    return simhash.drop_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what repeats an earlier place; every document stays."""
    return suffix_dedup.drop_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents in sequences of 2048 ids."""
    return packing.pack(packing.pieces(docs, vocabulary("byte_bpe_50k.json"), end_id=1))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("suffix_array_dedup", repeated_passages),
    ("packing", packed),
]

#: Trained quality rules, XXH64 fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark, name):  # what a stage has written for itself goes when its result is written
            docs = written(stage(spark, docs, sf_dir), name)
    return docs
