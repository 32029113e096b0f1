"""A collection of records with unique names: pages, lookups, inserts, updates, deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import new_path


def page(items: DataFrame, offset: int = 0, limit: int = 10, id_col: str = "id") -> DataFrame:
    """``limit`` rows from ``offset`` in order of id, each with the total number of rows."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100, offset 0 or more")
    total = items.agg(F.count(F.lit(1)).alias("total"))
    # one row
    return items.orderBy(id_col).limit(offset + limit).offset(offset).crossJoin(F.broadcast(total))


def lookup(items: DataFrame, key: object, key_col: str = "id") -> DataFrame:
    """The row of a key; raises where there is none."""
    found = items.where(F.col(key_col) == F.lit(key))
    if found.isEmpty():
        raise KeyError(key)
    return found


def taken_names(items: DataFrame, names: DataFrame, name_col: str = "name") -> DataFrame:
    """The names that the collection already has."""
    return names.join(items.select(name_col), name_col, "left_semi")


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    """``nth`` from 0 in the order given. The sorted rows are written once, since a second sort might
    deal them out otherwise; then a row's number is its place in its part plus the parts before."""
    path = new_path(rows.sparkSession, "numbered")
    rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    dealt = rows.sparkSession.read.parquet(path).withColumn("part", F.shiftright("at", 33))
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return dealt.join(before, "part").withColumn("nth", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "at", "before")


def insert(items: DataFrame, new: DataFrame, last_id: int | None = None) -> DataFrame:
    """``items`` and the new (name, description) rows, numbered on in order of name; a name that is
    taken, or twice among the new, is left out. ``last_id``: the last id ever given out, so that
    none of a deleted row is used again; without it, the largest one there is."""
    first = new.groupBy("name").agg(F.min("description").alias("description"))
    fresh = _numbered(first.join(items.select("name"), "name", "left_anti"), "name")
    last = items.agg(F.greatest(F.coalesce(F.max("id"), F.lit(0)), F.lit(last_id or 0)).alias("last"))
    made = fresh.crossJoin(F.broadcast(last)).select((F.col("last") + F.col("nth") + 1).cast("bigint").alias("id"), "name", "description")
    return items.select("id", "name", "description").unionByName(made)


def update(items: DataFrame, changes: DataFrame) -> DataFrame:
    """``items`` with name and description of the ids in ``changes`` replaced; their places stay.

    Raises where an id is not there or comes twice, and where a new name belongs to another row.
    """
    if not changes.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("an id is changed twice")
    if not changes.join(items.select("id"), "id", "left_anti").isEmpty():
        raise KeyError("an id is not there")
    changed = _updated(items, changes)
    if not changed.join(changes.select("name"), "name", "left_semi").groupBy("name").count().where("count > 1").isEmpty():
        raise ValueError("a name belongs to another row")
    return changed


def _updated(items: DataFrame, changes: DataFrame) -> DataFrame:
    new = changes.select("id", F.col("name").alias("new_name"), F.col("description").alias("new_description"), F.lit(True).alias("changed"))
    return items.join(new, "id", "left").select(
        "id",
        F.when(F.col("changed"), F.col("new_name")).otherwise(F.col("name")).alias("name"),
        F.when(F.col("changed"), F.col("new_description")).otherwise(F.col("description")).alias("description"),
    )


def delete(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids.select("id"), "id", "left_anti")


def resolve_alias(calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """``calls`` (name) with the canonical name that an alias stands for."""
    named = aliases.select(F.col("alias").alias("name"), "canonical")
    return calls.join(named, "name", "left").withColumn("resolved", F.coalesce("canonical", "name")).drop("canonical")
