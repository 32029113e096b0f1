"""The queries of the numbered operators and the SQL that their results must equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_table, exact_dedup, html_extract, packing, quality, sharding, simhash, suffix_dedup, token_files, url_filter
from .common import documents, scratch, settled


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        out = sharding.shard_by_bytes(documents(spark, sf_dir, "doc_id", "text"), 8)
        return out.select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
        )

    return settled(spark, "op1-result", make)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    with scratch(spark):
        model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model)


#: Fixed values of the query.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES).drop("unwanted")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        out = suffix_dedup.remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
        return out.select(
            "doc_id",
            "n_bytes",
            suffix_dedup.removed_bytes().alias("n_removed"),
            F.size("spans").cast("bigint").alias("n_spans"),
            F.sha2("kept", 256).alias("kept_sha256"),
        )

    return settled(spark, "op5-result", make)


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        docs = documents(spark, sf_dir, "doc_id", "text")
        folder = token_files.new_folder(docs)
        manifest = token_files.write_files(docs, folder, vocabulary("word_bpe_49k.json"), end_id=2)
        return token_files.read_files(manifest, folder).select(
            "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
        )

    return settled(spark, "op6-result", make)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        found = simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
        return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

    return settled(spark, "op7-result", make)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    encoded = bpe_table.encode(documents(spark, sf_dir, "doc_id", "text"), path)
    return bpe_table.decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        return packing.pack(packing.pieces(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=1))

    return settled(spark, "op9-result", make)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")

    def make() -> DataFrame:
        out = index.add(documents(spark, sf_dir, "doc_id", "text"))
        return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))

    try:
        return settled(spark, "op10-result", make)
    finally:
        index.drop()  # the query judges one table; a corpus that grows keeps its index by name


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_html_extraction": op2_html_extraction,
    "op3_quality": op3_quality,
    "op4_url_filter": op4_url_filter,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_files": op6_token_files,
    "op7_simhash": op7_simhash,
    "op8_bpe": op8_bpe,
    "op9_packing": op9_packing,
    "op10_exact_dedup": op10_exact_dedup,
}

SQL: dict[str, str] = {
    "op10_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
