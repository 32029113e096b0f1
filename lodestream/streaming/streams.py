"""Streams: periodic status rows, and a log that grows file by file."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def status_rows(spark: SparkSession, rows_per_batch: int = 1) -> DataFrame:
    """An unbounded stream of (status, ts)."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).load()
    return ticks.select(F.lit("ok").alias("status"), (F.unix_micros("timestamp") / 1e6).alias("ts"))


def watch(spark: SparkSession, every: float, emit: Callable[[DataFrame], None], batches: int) -> dict[str, object]:
    """Emit a status row every so many seconds, ``batches`` times; returns the closing row."""
    if every <= 0:
        raise ValueError("the interval must be positive")
    query = (
        status_rows(spark).writeStream.trigger(processingTime=f"{int(every * 1000)} milliseconds").foreachBatch(lambda df, _: emit(df)).start()
    )
    try:
        while query.isActive and (query.lastProgress is None or query.lastProgress["batchId"] < batches - 1):
            time.sleep(min(every, 0.1))
        if query.exception():
            raise query.exception()
    finally:
        query.stop()
    return {"status": "watch-stopped", "ts": time.time()}


def growing_log(spark: SparkSession, path: str, schema, names: str = "*") -> DataFrame:
    """New Parquet files of a folder, with such names, as they come."""
    return spark.readStream.schema(schema).option("pathGlobFilter", names).parquet(path)


def take_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append all that is there to ``out`` and stop; called again it takes what is new."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return query


def windowed_counts(events: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Events by tumbling window and type, for append mode: late rows beyond the watermark go."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def counts_by_type(stream: DataFrame, out_name: str) -> StreamingQuery:
    """Running count and latest time by event type in the in-memory table ``out_name``; a row for each type."""
    counts = stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))
    query = counts.writeStream.outputMode("complete").format("memory").queryName(out_name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
