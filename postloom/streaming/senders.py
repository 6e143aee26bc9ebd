"""Bursts from state per sender, with a timer for the end of each scheduled run."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from postloom import fixed
from postloom.functions.address import senders
from postloom.streaming.incremental import EVENT_TIME, MAX_WINDOW, RUN_HOURS, run_window, with_lateness

RUN_MS = RUN_HOURS * 3_600_000
BURST = "sender string, run_start timestamp, run_end timestamp, n bigint, prev_n bigint"


class SenderBursts(StatefulProcessor):
    """Counts of a sender's messages by the start of the run, in milliseconds: one value and one timer for a sender.

    When the watermark passes the end of the run that is due first, the timer compares every run that ended since the
    last one with the run before, and drops the counts that no later run needs; a run that had messages keeps its count
    one run longer, so what it holds goes then at the latest. Time to live by the clock would not follow the event time,
    so timers alone expire the state: an idle sender has none.

    A call to the state store costs more than the counting, so their number is by sender and batch, not by run.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the end up to which runs were compared, the time of the timer, and the counts: 64-bit pairs of start and count
        self.counts = handle.getValueState("counts", "closed bigint, due bigint, runs binary")

    def _known(self) -> tuple[int, int | None, dict[int, int]]:
        if not self.counts.exists():
            return -sys.maxsize, None, {}
        closed, due, runs = self.counts.get()
        return closed, due, dict(np.frombuffer(runs, "<i8").reshape(-1, 2).tolist())

    def _keep(self, closed: int, due: int | None, runs: dict[int, int]) -> None:
        """Store the counts; the timer moves if another run is due first."""
        first = min(start + RUN_MS if start + RUN_MS > closed else start + 2 * RUN_MS for start in runs)
        if first != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(first)
        self.counts.update((closed, first, np.array(sorted(runs.items()), "<i8").tobytes()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed, due, runs = self._known()
        for batch in rows:
            for start, n in zip(*np.unique(batch["run_start_ms"].to_numpy(), return_counts=True)):
                runs[int(start)] = runs.get(int(start), 0) + int(n)
        self._keep(closed, due, runs)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed, _, runs = self._known()
        # a timer is past when the watermark is behind it
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        ended = [start for start in sorted(runs) if closed < start + RUN_MS <= now]
        loud = [(start, runs[start], runs.get(start - RUN_MS, 0)) for start in ended]
        loud = [(start, n, prev_n) for start, n, prev_n in loud if n >= fixed.BURST_THRESHOLD and n > prev_n]
        left = {start: n for start, n in runs.items() if start + 2 * RUN_MS > now}
        if left:
            self._keep(now, None, left)  # the timer that called is gone
        else:
            self.counts.clear()
        if loud:
            starts = [start for start, _, _ in loud]
            yield pd.DataFrame({
                "sender": key[0], "run_start": pd.to_datetime(starts, unit="ms"),
                "run_end": pd.to_datetime([start + RUN_MS for start in starts], unit="ms"),
                "n": [n for _, n, _ in loud], "prev_n": [prev_n for _, _, prev_n in loud]})

    def close(self) -> None:
        pass


def sender_bursts(messages: DataFrame, max_window: str = MAX_WINDOW) -> DataFrame:
    """Bursts of the runs that the watermark has closed, from a stream of messages with ``internal_date`` and
    ``from_addr``. The query needs the RocksDB state store (``incremental.ROCKSDB``); state are at most as many
    counts for a sender as runs are open, whatever the number of messages."""
    named = with_lateness(messages, max_window).select(
        EVENT_TIME, F.explode(senders(F.col("from_addr"))).alias("sender"))
    named = named.withColumn("run_start_ms", F.unix_millis(run_window(F.col(EVENT_TIME))["start"]))
    return named.groupBy("sender").transformWithStateInPandas(SenderBursts(), BURST, "Append", "EventTime")
