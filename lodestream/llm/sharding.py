"""Sharding by fixed virtual slots (DataFrame operations only).

Records are hashed by id and checksum into ``SLOTS`` virtual slots; bytes are aggregated per
slot; a versioned map gives each slot its shard. The first version deals slots out by number.
Rebalancing edits the map by the bytes of the slots: a shard keeps its largest slots up to its
fair share, and the rest goes, largest first, to the shard with the fewest bytes so far, so
shards come out near equal in bytes. Adding a shard edits the map too: slots move only into
the new one.

A slot can't be parted by the map, so one that rows of one id and text overfill is cut before:
its records are hashed once more, with their row numbers, over all slots.

Defined results: a null text has no bytes, a null id hashes like any other value, rows that
repeat get places of their own, an empty table gives an empty result, other columns are
never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, whole_text, written

SLOTS = 4096
#: Bytes of a slot, as a multiple of the mean, from which it counts as overfull.
OVERFULL = 8
MAP = "virtual_slot int, shard int, version int"


def _slot(slots: int, *of: str | Column) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(slots)).cast("int")


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, row (a number of its own), virtual_slot."""
    text = whole_text(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    return rows.withColumn("virtual_slot", _slot(slots, "doc_id", "text_crc32"))


def slot_totals(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """virtual_slot, bytes, rows of every slot, empty ones too."""
    used = rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(used, "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("b", F.lit(0)).alias("bytes"), F.coalesce("n", F.lit(0)).alias("rows")
    )


def cut_overfull(rows: DataFrame, totals: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``rows`` (written, so that their numbers hold) with the records of overfull slots spread over all slots."""
    mean = F.avg("bytes").over(Window.partitionBy(F.lit(0)))  # of SLOTS rows
    overfull = totals.withColumn("mean", mean).where((F.col("bytes") > OVERFULL * F.col("mean")) & (F.col("rows") > 1))
    marked = rows.join(F.broadcast(overfull.select("virtual_slot", F.lit(True).alias("cut"))), "virtual_slot", "left")
    spread = F.when(F.col("cut"), _slot(slots, "doc_id", "text_crc32", "row")).otherwise(F.col("virtual_slot"))
    return marked.withColumn("virtual_slot", spread).drop("cut")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of a map: slots by number."""
    return spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"), F.lit(1).alias("version"))


def rebalance(slot_map: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """The next version, near equal in bytes.

    Each shard keeps its largest slots while they fit its fair share; what is over is dealt largest
    first to the lightest shard. The fold runs over the fixed number of slots, whatever the input.
    """
    held = slot_map.join(totals, "virtual_slot")
    fair = F.sum("bytes").over(Window.partitionBy(F.lit(0))) / shards
    so_far = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0))
    placed = held.withColumn("fair", fair).withColumn("stays", so_far <= F.col("fair"))
    one = placed.agg(
        F.max("version").alias("version"),
        F.collect_list(F.when(F.col("stays"), F.struct("virtual_slot", "shard", "bytes"))).alias("stay"),
        F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), "virtual_slot")))).alias("over"),
    )
    none = F.lit(0).cast("bigint")
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.aggregate(F.filter("stay", lambda x: x["shard"] == s), none, lambda total, x: total + x["bytes"]),
    )

    def deal(state: Column, slot: Column) -> Column:
        lightest = (F.array_position(state["load"], F.array_min(state["load"])) - 1).cast("int")
        return F.struct(
            F.transform(state["load"], lambda b, i: F.when(i == lightest, b - slot["less"]).otherwise(b)).alias("load"),
            F.concat(state["dealt"], F.array(lightest)).alias("dealt"),
        )

    start = F.struct(F.col("loads").alias("load"), F.array().cast("array<int>").alias("dealt"))
    dealt = one.withColumn("loads", loads).withColumn("dealt", F.aggregate("over", start, deal)["dealt"])
    moved = F.transform(F.arrays_zip("over", "dealt"), lambda x: F.struct(x["over"]["virtual_slot"].alias("virtual_slot"), x["dealt"].alias("shard")))
    stay = F.transform("stay", lambda x: F.struct(x["virtual_slot"].alias("virtual_slot"), x["shard"].alias("shard")))
    return dealt.select(F.explode(F.concat(stay, moved)).alias("x"), "version").select(
        "x.virtual_slot", F.col("x.shard").alias("shard"), (F.col("version") + 1).cast("int").alias("version")
    )


def add_shard(slot_map: DataFrame, totals: DataFrame) -> DataFrame:
    """The next version with one more shard: each old shard gives up slots worth its excess."""
    shards = F.max("shard").over(Window.partitionBy(F.lit(0))) + 1
    held = slot_map.join(totals, "virtual_slot").withColumn("shards", shards)
    held = held.withColumn("fair", F.sum("bytes").over(Window.partitionBy(F.lit(0))) / (F.col("shards") + 1))
    held = held.withColumn("load", F.sum("bytes").over(Window.partitionBy("shard")))
    given = F.sum("bytes").over(Window.partitionBy("shard").orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("given", given).select(
        "virtual_slot",
        F.when((F.col("bytes") > 0) & (F.col("given") <= F.col("load") - F.col("fair")), F.col("shards")).otherwise(F.col("shard")).cast("int").alias("shard"),
        (F.col("version") + 1).alias("version"),
    )


def store_map(slot_map: DataFrame, path: str) -> DataFrame:
    """Append a version to the map's table and return it as stored; older versions stay."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    return latest_map(slot_map.sparkSession, path)


def latest_map(spark: SparkSession, path: str) -> DataFrame:
    versions = spark.read.schema(MAP).parquet(path)
    return versions.where(F.col("version") == versions.agg(F.max("version")).first()[0])


def assign(rows: DataFrame, slot_map: DataFrame, totals: DataFrame) -> DataFrame:
    """Each row's shard and its place there, without gaps from 0.

    A place is the number of rows in the shard's slots before the row's slot plus the row's
    number in its slot, so no task ever holds more than one slot's rows.
    """
    in_shard = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = slot_map.join(totals, "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("rows").over(in_shard), F.lit(0)).alias("before")
    )
    in_slot = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("nth", F.row_number().over(in_slot) - 1)
    # the map has SLOTS rows, whatever the input
    return numbered.join(F.broadcast(places), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth")).cast("bigint").alias("slot"), "virtual_slot"
    )


def shard_by_bytes(docs: DataFrame, shards: int, map_path: str | None = None, slots: int = SLOTS) -> DataFrame:
    """All steps: slots, bytes per slot, a stored map that is rebalanced, and every record's shard and place.

    A map that is stored at ``map_path`` already is edited; else it begins with version 1.
    """
    spark = docs.sparkSession
    hashed = written(with_slots(docs, slots=slots), "hashed")
    rows = written(cut_overfull(hashed, written(slot_totals(hashed, slots), "hashed-totals"), slots), "slotted")
    totals = written(slot_totals(rows, slots), "slot-totals")
    if map_path is None:
        map_path = new_path(spark, "slot-map")
        stored = store_map(first_map(spark, shards, slots), map_path)
    else:
        stored = latest_map(spark, map_path)
    return assign(rows, store_map(rebalance(stored, totals, shards), map_path), totals)
