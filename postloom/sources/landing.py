"""The landing table of fetched messages, in a folder per day of the internal date.

A fetch asks for messages from some time on: its day prunes folders before any file is opened, and the time itself is
pushed into the files of the days left. Many fetch windows at once prune by the days that they cover, at run time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postloom.operators import messages as ops
from postloom.session import TEXT_CODEC, stage

DAY = "internal_day"


class Landing:
    """Messages below ``root``. Messages without an internal date are kept in a folder of their own; no window has them."""

    def __init__(self, spark: SparkSession, root: str, schema: str | StructType):
        self.spark = spark
        self.root = root.rstrip("/")
        empty = spark.createDataFrame([], schema)
        self.schema = empty.schema
        # partition values come back as days, not as what their text looks like
        self._stored = empty.withColumn(DAY, F.lit(None).cast("date")).schema

    def write(self, messages: DataFrame) -> None:
        """Append fetched messages. The rebalance step gives a day few files, a crowded day several."""
        columns = [f.name for f in self.schema]
        rows = messages.select(*columns, F.to_date("internal_date").alias(DAY))
        rows.hint("rebalance", F.col(DAY)).write.mode("append").option("compression", TEXT_CODEC).partitionBy(DAY).parquet(
            self.root)

    def read(self) -> DataFrame:
        """All messages with their day."""
        return self.spark.read.schema(self._stored).parquet(self.root)

    def stream(self) -> DataFrame:
        """The table as a file stream: a checkpoint remembers the files that were read."""
        return self.spark.readStream.schema(self._stored).parquet(self.root).drop(DAY)

    def since(self, since: Column | dt.datetime, unread_only: bool = False) -> DataFrame:
        """Messages from ``since`` on; folders of earlier days are not listed as input."""
        at = since if isinstance(since, Column) else F.lit(since).cast("timestamp_ntz")
        days = self.read().where(F.col(DAY) >= F.to_date(at))
        return ops.search_window(days, at, unread_only).drop(DAY)

    def windows(self, windows: DataFrame) -> DataFrame:
        """Messages of each fetch window ``run_id, since, until``, both ends included, with the ``run_id``.

        A window is one row per day that it touches, so the join is on the day and its days prune the folders that
        are read. The windows are staged: Spark then knows their size, which decides whether they are broadcast and
        prune at run time. Empty windows have no messages.
        """
        stored = stage(windows.select("run_id", "since", "until"), "windows")
        days = stored.where(F.col("since") <= F.col("until")).select(
            "run_id", "since", "until", F.explode(F.sequence(F.to_date("since"), F.to_date("until"))).alias(DAY))
        rows = self.read().drop("run_id")
        return rows.join(days, DAY).where(F.col("internal_date").between(F.col("since"), F.col("until"))).select(
            "run_id", *[f.name for f in self.schema if f.name != "run_id"])

    def ingest(self, account_status: DataFrame | None = None):
        """A source for ``plans.run.run_once``: what landed since, and the state of the accounts' fetches.

        Without a state, accounts that have messages in the window count as fetched.
        """

        def fetch(since: dt.datetime) -> tuple[DataFrame, DataFrame]:
            found = self.since(since)
            status = account_status
            if status is None:
                status = found.select("account_label").distinct().select(
                    "account_label", F.lit("ok").alias("status"), F.lit("").alias("error"))
            return found, status

        return fetch
