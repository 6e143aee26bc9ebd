"""Runs driven by a checkpoint: each takes the landed files that no finished run has read."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.params import TriageOptions
from postloom.plans.run import run_once
from postloom.plans.triage import TriageResult
from postloom.sources.ledger import Ledger
from postloom.streaming.incremental import stream_id

# batch, its number -> nothing; inside a ledger transaction
Step = Callable[[DataFrame, int], None]


def take_increment(stream: DataFrame, ledger: Ledger, checkpoint: str, step: Step) -> None:
    """Give what landed since the last time to ``step``, once.

    File offsets live in the checkpoint, what the step writes to the ledger is one commit that carries the number of
    the batch. If the step fails, both stay as they were and the next call reads the same files again; a
    batch that was committed is not given out a second time. Without new files there is no step.
    """
    spark = stream.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        with ledger.transaction(stream_id(spark, checkpoint), number) as new:
            if new:
                step(batch, number)

    (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def run_increment(spark: SparkSession, ledger: Ledger, landed: DataFrame, provider: Callable[[str], str],
                  payload_path: str, checkpoint: str, options: TriageOptions = TriageOptions(),
                  now: dt.datetime | None = None, account_status: DataFrame | None = None,
                  **more) -> list[TriageResult]:
    """One scheduled run over the landed messages that no run has read, from a stream such as ``Landing.stream()``.

    The last completed run plays no part in what is read, so a message that lands late is not missed; the look-back
    cap of the options still leaves out what is too old. Without ``account_status`` the accounts in the increment
    count as fetched. Gives the result of the run, or nothing where nothing landed.
    """
    results = []

    def step(batch: DataFrame, _: int) -> None:
        status = account_status
        if status is None:
            status = batch.select("account_label").distinct().select(
                "account_label", F.lit("ok").alias("status"), F.lit("").alias("error"))
        results.append(run_once(spark, ledger, lambda since: (batch, status), provider, payload_path, options, now,
                                window_hours=options.max_window_hours, **more))

    take_increment(landed, ledger, checkpoint, step)
    return results
