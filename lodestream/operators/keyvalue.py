"""Key-value tables: the last value wins, overlays, upserts, deletes, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_bool


def last_by_key(rows: DataFrame, seq: str = "_pos") -> DataFrame:
    """key and its last value by ``seq``; combined in each task before the shuffle."""
    return rows.groupBy("key").agg(F.max_by("value", seq).alias("value"))


def upsert(store: DataFrame, changes: DataFrame) -> DataFrame:
    """The store after the changes; a change wins over what is there."""
    both = store.select("key", "value", F.lit(0).alias("_pos")).unionByName(changes.select("key", "value", F.lit(1).alias("_pos")))
    return last_by_key(both)


def delete(store: DataFrame, keys: DataFrame, strict: bool = False) -> DataFrame:
    """The store without the keys; ``strict``: raises where one isn't there."""
    if strict and not keys.select("key").join(store, "key", "left_anti").isEmpty():
        raise KeyError("a key is not there")
    return store.join(keys.select("key"), "key", "left_anti")


def replaced(pairs: DataFrame) -> DataFrame:
    """A whole new store: every value as text."""
    return pairs.select("key", F.coalesce(F.col("value").cast("string"), F.lit("None")).alias("value"))


def overlay(file: DataFrame, env: DataFrame) -> DataFrame:
    """key, value and, where only the file has it as true or false, its boolean; the environment wins."""
    f = file.select("key", F.col("value").alias("in_file"))
    e = env.select("key", F.col("value").alias("in_env"))
    return f.join(e, "key", "full").select(
        "key", F.coalesce("in_env", "in_file").alias("value"), F.when(F.col("in_env").isNull(), parse_bool(F.col("in_file"))).alias("as_boolean")
    )


def merge_fields(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Two map columns ``fields`` as one; of equal keys the right value wins."""
    r = right.select(on, F.col("fields").alias("right_fields"))
    kept = F.map_filter("fields", lambda k, _: ~F.coalesce(F.array_contains(F.map_keys("right_fields"), k), F.lit(False)))
    merged = F.when(F.col("right_fields").isNull(), F.col("fields")).otherwise(F.map_concat(kept, "right_fields"))
    return left.join(r, on, "left").select(on, merged.alias("fields"))


def listed(store: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Keys in order, by code point or without regard to case."""
    return store.select("key").orderBy(*([F.lower("key")] if ignore_case else []), "key")
