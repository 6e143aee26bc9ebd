"""Incremental reading, deduplication, tumbling run counts and burst detection on streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postloom import fixed
from postloom.functions.address import senders
from postloom.session import settings, shared_root
from postloom.sources.ledger import Ledger

RUN_LENGTH, RUN_OFFSET = "6 hours", "2 hours"
RUN_HOURS = 6
MAX_WINDOW = f"{fixed.MAX_WINDOW_HOURS} hours"
EVENT_TIME = "event_time"
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass":
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_window(time: Column) -> Column:
    """The scheduled run a time falls into: 02-08, 08-14, 14-20, 20-02 o'clock."""
    return F.window(time, RUN_LENGTH, RUN_LENGTH, RUN_OFFSET)


def with_lateness(messages: DataFrame, max_window: str = MAX_WINDOW) -> DataFrame:
    """Adds the event time and a watermark: rows older than the look-back cap are late."""
    return messages.withColumn(EVENT_TIME, F.col("internal_date").cast("timestamp")).withWatermark(
        EVENT_TIME, max_window)


def distinct_messages(messages: DataFrame, max_window: str = MAX_WINDOW) -> DataFrame:
    """Each key once among overlapping deliveries inside the look-back; late rows are dropped."""
    return with_lateness(messages, max_window).dropDuplicatesWithinWatermark(
        ["account_label", "uid"]).drop(EVENT_TIME)


def recent(messages: DataFrame, now: Column, max_hours: int = fixed.MAX_WINDOW_HOURS) -> DataFrame:
    """Batch form of the look-back cap."""
    cap = F.make_dt_interval(F.lit(0), F.lit(max_hours))
    return messages.where(F.col("internal_date") >= now - cap)


def record_stream(rows: DataFrame, ledger: Ledger, checkpoint: str, max_window: str | None = None) -> StreamingQuery:
    """Record each micro-batch in the ledger exactly once, whatever was recorded before.

    The ledger's version keeps the number of the last batch beside the data it belongs to, so a batch that was
    committed before a crash is not looked at again; what an uncommitted one wrote is in no version. Keys that other
    runs recorded are looked up in the ledger, which opens only files that may hold one. With ``max_window``, keys
    that come again within it are met in RocksDB state that expires with the watermark on ``processed_at``, before
    any lookup; rows that are older than the watermark are then too late and dropped.
    """
    spark = rows.sparkSession
    state = {}
    if max_window is not None:
        time = F.col("processed_at").cast("timestamp")
        rows = rows.withColumn(EVENT_TIME, time).withWatermark(EVENT_TIME, max_window).dropDuplicatesWithinWatermark(
            ["account_label", "uid"]).drop(EVENT_TIME)
        state = ROCKSDB

    def write(batch: DataFrame, number: int) -> None:
        with ledger.transaction(stream_id(spark, checkpoint), number) as new:
            if new:
                ledger.record_messages(batch)

    with settings(spark, state):
        return (rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a checkpoint was given when it was made; a new checkpoint at the same path has another."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def run_counts(messages: DataFrame, key: str) -> DataFrame:
    """Messages per scheduled run and key; works on a batch and, with a watermark, on a stream."""
    time = EVENT_TIME if EVENT_TIME in messages.columns else "internal_date"
    return (
        messages.where(F.col(key) != "").groupBy(run_window(F.col(time)).alias("run"), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("run.start").alias("run_start"), F.col("run.end").alias("run_end"), key, "n")
    )


def bursts(messages: DataFrame) -> DataFrame:
    """Senders with three or more messages in a run and more than in the run before (0 if none).

    A window of two run lengths that slides by one holds a run and its predecessor, so one
    aggregation compares them. It works on a batch and, with a watermark, on a stream: the state is
    two counters per sender and open window, whatever the number of messages.
    """
    time = F.col(EVENT_TIME if EVENT_TIME in messages.columns else "internal_date")
    pair = F.window(time, f"{2 * RUN_HOURS} hours", RUN_LENGTH, RUN_OFFSET)
    start = F.col("pair.start") + F.expr(f"INTERVAL '{RUN_HOURS}' HOUR")
    named = messages.withColumn("pair", pair).withColumn(
        "sender", F.explode(senders(F.col("from_addr"))))
    counts = named.groupBy("pair", "sender").agg(
        F.count_if(time >= start).alias("n"), F.count_if(time < start).alias("prev_n"))
    loud = (F.col("n") >= fixed.BURST_THRESHOLD) & (F.col("n") > F.col("prev_n"))
    return counts.where(loud).select(
        "sender", start.alias("run_start"), F.col("pair.end").alias("run_end"), "n", "prev_n")


def burst_stream(messages: DataFrame, max_window: str = MAX_WINDOW) -> DataFrame:
    """Bursts of the runs that the watermark has closed."""
    return bursts(with_lateness(messages, max_window))


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is available now into files of the shared folder and read them."""
    spark: SparkSession = stream.sparkSession
    base = f"{shared_root(spark)}/streams/{name}-{uuid.uuid4().hex}"
    with settings(spark, ROCKSDB):
        query = (stream.writeStream.format("parquet").option("path", f"{base}/data")
                 .option("checkpointLocation", f"{base}/checkpoint").outputMode("append")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")
