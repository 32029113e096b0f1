import pytest
from pyspark.sql import functions as F

from lodestream.streaming import streams

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_watch_emits_rows_and_a_closing_one(spark):
    seen = []
    last = streams.watch(spark, 0.1, lambda df: seen.extend(df.collect()), batches=2)
    assert len(seen) >= 2 and seen[0].status == "ok" and last["status"] == "watch-stopped"
    with pytest.raises(ValueError):
        streams.watch(spark, 0, print, 1)


def test_a_growing_log_is_taken_file_by_file(spark, tmp_path):
    events = spark.read.parquet(EVENTS)
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    events.where("event_id < 100").write.parquet(src)
    stream = streams.growing_log(spark, src, events.schema)
    streams.take_available(stream, out, mark)
    assert spark.read.parquet(out).count() == 100
    events.where("event_id between 100 and 149").write.mode("append").parquet(src)
    streams.take_available(stream, out, mark)
    assert spark.read.parquet(out).count() == 150
    streams.counts_by_type(stream, "running_counts")
    want = {r.event_type: r.n for r in events.where("event_id < 150").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r.event_type: r.n for r in spark.table("running_counts").collect()} == want


def test_windows_close_behind_the_watermark(spark, tmp_path):
    events = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    events.coalesce(1).write.parquet(src)
    counts = streams.windowed_counts(streams.growing_log(spark, src, events.schema)).select("w.start", "event_type", "n")
    streams.take_available(counts, out, mark)
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(out).collect()}
    batch = streams.windowed_counts(spark.read.parquet(src)).select("w.start", "event_type", "n")
    want = {(r.start, r.event_type): r.n for r in batch.collect()}
    assert got and all(want[k] == n for k, n in got.items())
