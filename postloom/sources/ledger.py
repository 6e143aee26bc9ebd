"""Ledger tables on shared storage, with idempotent sinks.

Every write is a commit of new segments (``versions``): readers see all of it or nothing, and keep their version. Every
sink can be repeated after a failure: inserts skip keys already stored, a newer snapshot of a run supersedes the
older one, and run states are a versioned log. Segments of like size are merged as they add up, so a table has few
files whatever the number of writes; what is superseded goes in the merge. One writer appends to a ledger at a time;
a second one fails.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom import schemas
from postloom.session import TEXT_CODEC, stage
from postloom.sources import keyed
from postloom.sources.versions import Segment, State, Versions

SNAPSHOT_TABLES = ("run_digest_label_counts", "run_digest_sender_counts",
                   "run_digest_domain_counts", "run_digest_summaries")
KEYS = {"processed_messages": ["account_label", "uid"], "flags_applied": ["account_label", "uid", "flag"]}
FIRST_BY = {"processed_messages": ["processed_at", "run_id", "classification", "digest_excerpt"],
            "flags_applied": ["applied_at"]}
# So many neighbouring segments of like size are merged; a segment is of the next size with so many times the rows.
MERGE = 8
SMALL = 1_000


def once_per_key(new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of ``new`` per key, the smallest in ``order``."""
    value = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min_by(F.struct(*value), F.struct(*order)).alias("v"))
    return once.select(*keys, "v.*").select(*new.columns)


def latest_fields(log: DataFrame) -> DataFrame:
    """One row per run: its highest version, and of each field the last value that is not null."""
    fields = ("started_at", "finished_at", "status", "message_count", "error")

    def latest(name: str):
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("version"))).alias(name)

    return log.groupBy("id").agg(*[latest(f) for f in fields], F.max("version").alias("version"))


def current_runs(log: DataFrame) -> DataFrame:
    """Latest state of every run. Fields a later change leaves null keep their value."""
    return latest_fields(log).select(
        "id", "started_at", "finished_at", "status",
        F.coalesce("message_count", F.lit(0).cast("bigint")).alias("message_count"),
        F.coalesce("error", F.lit("")).alias("error"))


def new_runs(requests: DataFrame, now) -> DataFrame:
    """Run rows with their defaults: a fresh id, the current time, status ``running``."""
    return requests.select(
        F.coalesce("id", F.uuid()).alias("id"), F.coalesce("started_at", now).alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("finished_at"),
        F.coalesce(F.when(F.col("status") != "", F.col("status")), F.lit("running")).alias("status"),
        F.lit(0).cast("bigint").alias("message_count"), F.lit("").alias("error"),
        F.lit(0).cast("bigint").alias("version"))


def unknown_updates(log: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates that name no recorded run."""
    return updates.join(log.select("id"), "id", "left_anti")


def snapshot_counts(counts: DataFrame, key: str) -> DataFrame:
    """Count rows worth storing: positive ones."""
    return counts.where(F.col("n") > 0).select("run_id", key, F.col("n").cast("bigint").alias("n"))


def counts_of_run(counts: DataFrame, run_id: str) -> DataFrame:
    """Stored counts of one run as (key, n) rows."""
    return counts.where(F.col("run_id") == run_id).drop("run_id")


def get_run(runs: DataFrame, run_id: str) -> DataFrame:
    """The run with this id; empty when there is none."""
    return runs.where(F.col("id") == run_id)


def latest_snapshots(headers: DataFrame) -> DataFrame:
    """The header with the highest number of every run."""
    value = [c for c in headers.columns if c not in ("run_id", "seq")]
    return headers.groupBy("run_id").agg(F.max_by(F.struct(*value), "seq").alias("v"), F.max("seq").alias("seq")).select(
        "run_id", "v.*", "seq")


def mergeable(segments: tuple[Segment, ...], least: int = MERGE) -> tuple[int, int] | None:
    """The first longest stretch of ``least`` or more neighbouring segments up to some size, smallest sizes first.

    Stretches keep the commit order, as later rows of a log go before earlier ones. One large segment among small
    ones, half of the stretch's rows and more, is not written again for them.
    """
    sizes = [max(0, int(math.log(max(1, s.rows) / SMALL, least)) + 1) if s.rows > SMALL else 0 for s in segments]
    for size in sorted(set(sizes)):
        best, start = None, 0
        for k in range(len(sizes) + 1):
            if k == len(sizes) or sizes[k] > size:
                rows = [s.rows for s in segments[start:k]]
                if len(rows) >= least and sum(rows) >= 2 * max(rows) and (best is None or len(rows) > best[1] - best[0]):
                    best = (start, k)
                start = k + 1
        if best:
            return best
    return None


class Ledger:
    """The eight ledger tables below one folder.

    ``keep_hours`` is how long readers may use a version after it was superseded.
    """

    def __init__(self, spark: SparkSession, root: str, keep_hours: float = 24.0):
        self.spark = spark
        self.versions = Versions(spark, root)
        self.keep_hours = keep_hours
        self._open: State | None = None

    @property
    def root(self) -> str:
        return self.versions.root

    def state(self) -> State:
        """The newest version, or within a transaction what it has written so far."""
        return self._open if self._open is not None else self.versions.latest()

    def read(self, table: str, state: State | None = None) -> DataFrame:
        """A stored table, by default of the newest version; empty with the declared schema before the first write."""
        return self._read(table, (state or self.state()).segments(table))

    def _read(self, table: str, segments: tuple[Segment, ...]) -> DataFrame:
        schema = schemas.LEDGER[table]
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{table}/{s.name}" for s in segments])

    def lookup(self, table: str, keys: DataFrame) -> DataFrame:
        """Those of ``keys`` that a keyed table holds, each once; only files that may hold one are read."""
        return keyed.lookup(keys, KEYS[table], self.versions, table, self.state().segments(table),
                            schemas.LEDGER[table])

    @contextmanager
    def transaction(self, stream: str | None = None, batch: int = -1) -> Iterator[bool]:
        """All writes inside are one commit, with the number of a stream's batch where one is named.

        Gives False where that batch is in the ledger already; the block must then write nothing. An error inside
        leaves the ledger as it was.
        """
        if self._open is not None:
            raise RuntimeError("transactions do not nest")
        start = self.versions.latest()
        if stream is not None and start.batches.get(stream, -1) >= batch:
            yield False
            return
        self._open = start if stream is None else replace(start, batches={**start.batches, stream: batch})
        try:
            yield True
            done = self._open
        finally:
            self._open = None
        if done != start:
            self.versions.commit(done)
            self.compact()

    def _publish(self, added: dict[str, Segment]) -> None:
        """Append segments, in one commit of their own or in the open transaction."""
        state = self.state()
        for table, segment in added.items():
            if segment.rows:
                state = state.with_table(table, (*state.segments(table), segment))
        if self._open is not None:
            self._open = state
        elif any(s.rows for s in added.values()):
            self.versions.commit(state)
            self.compact()

    def _segment(self, table: str, rows: DataFrame, most_rows: int | None = None) -> Segment:
        """Write rows as a new segment that no version has yet."""
        names = [f.split()[0] for f in schemas.LEDGER[table].split(", ")]
        name = uuid.uuid4().hex
        path = f"{self.root}/{table}/{name}"
        rows = rows.select(*names)
        if table in KEYS:
            most_rows = rows.count() if most_rows is None else most_rows
            counts = keyed.write(rows, KEYS[table], path, f"{self.root}/_filters/{table}/{name}", most_rows)
            return Segment(name, *counts)
        rows.write.parquet(path)
        return Segment(name, self.spark.read.schema(schemas.LEDGER[table]).parquet(path).count())

    def _append(self, table: str, rows: DataFrame) -> None:
        self._publish({table: self._segment(table, rows)})

    def _insert(self, table: str, rows: DataFrame) -> None:
        """Append rows whose key is not stored yet, one per key. The rows are computed once; those whose key comes once
        are moved only to their file."""
        keys = KEYS[table]
        held = stage(rows, table, TEXT_CODEC)
        found = stage(held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), f"{table}_keys")
        once = held
        if found.where("_n > 1").limit(1).count():
            key = F.struct(*keys).alias("_key")  # a struct as the key: null equals null in its fields
            keyed_rows, several = held.withColumn("_key", key), found.where("_n > 1").select(key)
            once = keyed_rows.join(several, "_key", "left_anti").drop("_key").unionByName(once_per_key(
                keyed_rows.join(several, "_key", "left_semi").drop("_key"), keys, FIRST_BY[table]))
        fresh = once.join(self.lookup(table, found), keys, "left_anti")
        self._publish({table: self._segment(table, fresh, found.count())})

    def compact(self, least: int = MERGE) -> None:
        """Merge stretches of like segments until there are none, each by a commit, then retire old versions.

        A failure leaves the version before; a reader is not disturbed. Of the runs log the latest fields stay,
        of snapshots those that are not superseded.
        """
        merged = False
        for table in schemas.LEDGER:
            while stretch := mergeable(self.versions.latest().segments(table), least):
                state, (start, end) = self.versions.latest(), stretch
                segments = state.segments(table)
                rows = self._read(table, segments[start:end])
                if table == "runs":
                    rows = latest_fields(rows)
                elif table == "run_digest_summaries":
                    rows = latest_snapshots(rows)
                elif table in SNAPSHOT_TABLES:
                    latest = latest_snapshots(self.read("run_digest_summaries", state))
                    rows = rows.join(latest.select("run_id", "snapshot_id"), ["run_id", "snapshot_id"], "left_semi")
                if table not in KEYS:
                    rows = rows.hint("rebalance")
                whole = self._segment(table, rows, sum(s.rows for s in segments[start:end]))
                self.versions.commit(state.with_table(table, (*segments[:start], whole, *segments[end:])))
                merged = True
        if merged:
            self.retire()

    def retire(self) -> list[str]:
        """Delete what only versions superseded over ``keep_hours`` ago have, and what failed writes left."""
        gone = self.versions.retire(list(schemas.LEDGER), self.keep_hours * 3600)
        self.versions.retire([f"_filters/{t}" for t in KEYS], self.keep_hours * 3600)
        return gone

    def runs(self) -> DataFrame:
        return current_runs(self.read("runs"))

    def record_runs(self, requests: DataFrame, now) -> DataFrame:
        """Append new runs and return them as stored. The fresh ids are drawn once."""
        rows = stage(new_runs(requests, now), "runs")
        self._append("runs", rows)
        return rows

    def finish_runs(self, updates: DataFrame) -> None:
        """Append the final state of runs: ``id, finished_at, status, message_count, error``."""
        log = self.read("runs")
        missing = unknown_updates(log, updates).limit(1).count()
        if missing:
            raise LookupError("an update names a run that was never recorded")
        versions = log.groupBy("id").agg((F.max("version") + 1).alias("version"))
        rows = updates.join(versions, "id").withColumn(
            "started_at", F.lit(None).cast("timestamp_ntz"))
        self._append("runs", rows)

    def record_messages(self, rows: DataFrame) -> None:
        """Insert processed messages; the first writer of a key wins."""
        self._insert("processed_messages", rows)

    def record_flags(self, rows: DataFrame) -> None:
        """Insert applied flags, once per key and flag."""
        self._insert("flags_applied", rows)

    def record_digests(self, rows: DataFrame) -> None:
        self._append("digests", rows)

    def save_snapshots(self, header: DataFrame, labels: DataFrame, senders: DataFrame,
                       domains: DataFrame) -> None:
        """Replace the snapshot of every run in ``header``, in one commit.

        Older snapshots of a run are superseded by the number of the new one. The rebalance step keeps a run's
        rows together but splits a large run over several tasks.
        """
        snapshot = F.lit(uuid.uuid4().hex)
        last = self.read("run_digest_summaries").agg(F.max("seq")).first()[0]
        tables = [snapshot_counts(labels, "label"), snapshot_counts(senders, "sender"),
                  snapshot_counts(domains, "domain"), header.withColumn("seq", F.lit((last or 0) + 1).cast("bigint"))]
        self._publish({name: self._segment(name, df.withColumn("snapshot_id", snapshot).hint(
            "rebalance", F.col("run_id"))) for name, df in zip(SNAPSHOT_TABLES, tables)})

    def snapshot_headers(self) -> DataFrame:
        """The latest snapshot header of every run."""
        return latest_snapshots(self.read("run_digest_summaries")).drop("seq")

    def snapshot_counts(self, key: str) -> DataFrame:
        """``run_id, key, n`` of the latest snapshots; ``key`` is label, sender or domain."""
        latest = self.snapshot_headers().select("run_id", "snapshot_id")
        return self.read(f"run_digest_{key}_counts").join(latest, ["run_id", "snapshot_id"], "left_semi").drop("snapshot_id")


def write_payloads(lines: DataFrame, path: str) -> None:
    """Digest lines as text files, one folder per run.

    Range partitioning on the line order splits a long digest over tasks; file names keep the order.
    """
    order = ["run_id", "section", "grp", "item", "key", "line"]
    (lines.repartitionByRange(*order).sortWithinPartitions(*order)
     .select("run_id", F.col("text").alias("value"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id").text(path))
