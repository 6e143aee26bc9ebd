"""Queries: the scheduled runs as windows and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from postloom.catalog import query
from postloom.catalog.statistics import SENDERS
from postloom.plans.tables import VIEWS, Tables
from postloom.session import shared_root
from postloom.sources.ledger import Ledger
from postloom.streaming import incremental

RUN_START = "time_bucket(INTERVAL '6' HOUR, internal_date, TIMESTAMP '2000-01-01 02:00:00')"


def message_stream(t: Tables):
    """The messages view over the events as a file stream."""
    schema = t.events.schema
    source = t.spark.readStream.schema(schema).parquet(f"{t.folder}/events*.parquet")
    return t.spark.sql(VIEWS["messages"].replace("FROM events", "FROM {events}"), events=source)


@query("stm_01_watermark", """
WITH newest AS (SELECT max(finished_at) AS now FROM runs)
SELECT account_label, uid, internal_date FROM messages
WHERE internal_date >= (SELECT greatest(max(finished_at) FILTER (status = 'completed' AND finished_at < now),
  max(now) - INTERVAL '72' HOUR) FROM runs, newest)""")
def _(t: Tables):
    from postloom.functions.dates import fetch_since
    from postloom.operators.ranking import last_completed
    newest = t.runs.agg(F.max("finished_at")).scalar()
    before = last_completed(t.runs.where(F.col("finished_at") < newest))
    since = before.select(fetch_since(newest, F.col("finished_at")).alias("since"))
    return t.messages.where(F.col("internal_date") >= since.scalar()).select(
        "account_label", "uid", "internal_date")


@query("stm_02_stream_dedup", "SELECT account_label, uid, folder FROM messages")
def _(t: Tables):
    doubled = message_stream(t).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = incremental.distinct_messages(doubled)
    return incremental.drain(once.select("account_label", "uid", "folder"), "distinct")


@query("stm_02_ledger_dedup", """
SELECT run_id, account_label, uid, label AS classification FROM messages""")
def _(t: Tables):
    base = f"{shared_root(t.spark)}/streams/ledger-{uuid.uuid4().hex}"
    ledger = Ledger(t.spark, f"{base}/ledger")
    rows = message_stream(t).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        "run_id", "account_label", "uid", "is_read", F.col("label").alias("classification"),
        F.lit("").alias("digest_excerpt"), F.col("internal_date").alias("processed_at"))
    for attempt in ("first", "second"):  # the second query starts over and adds nothing
        incremental.record_stream(rows, ledger, f"{base}/{attempt}").awaitTermination()
    return ledger.read("processed_messages").select(
        "run_id", "account_label", "uid", "classification")


@query("stm_03_late_cap", """
SELECT account_label, uid FROM messages
WHERE internal_date >= (SELECT max(internal_date) - INTERVAL '72' HOUR FROM messages)""")
def _(t: Tables):
    now = t.messages.agg(F.max("internal_date")).scalar()
    return incremental.recent(t.messages, now).select("account_label", "uid")


@query("stm_04_run_counts_by_label", f"""
SELECT {RUN_START} AS run_start, {RUN_START} + INTERVAL '6' HOUR AS run_end, label, count(*) AS n
FROM messages GROUP BY ALL""")
def _(t: Tables):
    return incremental.run_counts(t.messages, "label")


@query("stm_04_run_counts_by_sender", f"""
WITH {SENDERS} SELECT {RUN_START} AS run_start, {RUN_START} + INTERVAL '6' HOUR AS run_end, sender, count(*) AS n
FROM senders WHERE sender <> '' GROUP BY ALL""")
def _(t: Tables):
    from postloom.operators.messages import with_sender
    return incremental.run_counts(with_sender(t.messages), "sender")


BURST_SQL = f"""
WITH {SENDERS}, c AS (SELECT {RUN_START} AS run_start, sender, count(*) AS n FROM senders
  WHERE sender <> '' GROUP BY ALL),
d AS (SELECT c.sender, c.run_start, c.run_start + INTERVAL '6' HOUR AS run_end, c.n, coalesce(p.n, 0) AS prev_n
  FROM c LEFT JOIN c p ON p.sender = c.sender AND p.run_start = c.run_start - INTERVAL '6' HOUR)
SELECT sender, run_start, run_end, n, prev_n FROM d WHERE n >= 3 AND n > prev_n"""


@query("stm_05_bursts", BURST_SQL)
def _(t: Tables):
    return incremental.bursts(t.messages)


@query("stm_05_burst_stream", BURST_SQL + """
AND run_end <= (SELECT max(internal_date) - INTERVAL '72' HOUR FROM messages)""")
def _(t: Tables):
    found = incremental.drain(incremental.burst_stream(message_stream(t)), "bursts")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("run_start", "run_end")})



@query("stm_05_sender_state", BURST_SQL + """
AND run_end <= (SELECT max(internal_date) - INTERVAL '72' HOUR FROM messages)""")
def _(t: Tables):
    from postloom.streaming.senders import sender_bursts
    found = incremental.drain(sender_bursts(message_stream(t)), "sender_bursts")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("run_start", "run_end")})


@query("stm_01_increments", """
SELECT concat('increment ', CAST(uid % 2 AS STRING)) AS run_id, account_label, uid FROM messages""")
def _(t: Tables):
    from postloom.sources.landing import Landing
    from postloom.streaming.increments import take_increment
    base = f"{shared_root(t.spark)}/streams/increments-{uuid.uuid4().hex}"
    rows = t.messages.select("account_label", "uid", "internal_date", "is_read", F.col("label").alias("classification"))
    landing, ledger = Landing(t.spark, f"{base}/landed", rows.schema), Ledger(t.spark, f"{base}/ledger")

    def step(batch, number: int) -> None:
        ledger.record_messages(batch.select(
            F.lit(f"increment {number}").alias("run_id"), "account_label", "uid", "is_read", "classification",
            F.lit("").alias("digest_excerpt"), F.col("internal_date").alias("processed_at")))

    for part in (0, 1):  # what lands between two runs is read by the second only
        landing.write(rows.where(F.col("uid") % 2 == part))
        take_increment(landing.stream(), ledger, f"{base}/checkpoint", step)
    return ledger.read("processed_messages").select("run_id", "account_label", "uid")
