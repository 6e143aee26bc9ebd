"""Queries: the ledger sinks, each written twice to show that repeating a write changes nothing."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from postloom import schemas
from postloom.catalog import query
from postloom.catalog.statistics import SENDERS
from postloom.operators import flags, stats
from postloom.plans.tables import Tables
from postloom.session import shared_root
from postloom.sources import ledger as store
from postloom.sources.ledger import Ledger

NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def fresh_ledger(t: Tables) -> Ledger:
    return Ledger(t.spark, f"{shared_root(t.spark)}/ledgers/{uuid.uuid4().hex}")


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


def run_requests(t: Tables):
    """Runs to open; some leave their start or status to the defaults."""
    return t.runs.select(
        "id", F.when(F.col("status") != "partial", F.col("started_at")).alias("started_at"),
        F.when(F.col("status") == "completed", F.lit("")).alias("status"))


@query("snk_01_record_runs", f"""
SELECT id, CASE WHEN status <> 'partial' THEN started_at ELSE {NOW} END AS started_at, 'running' AS status,
  CAST(0 AS BIGINT) AS message_count, '' AS error FROM runs""")
def _(t: Tables):
    book = fresh_ledger(t)
    book.record_runs(run_requests(t), now())
    return book.runs().select("id", "started_at", "status", "message_count", "error")


@query("snk_02_finish_runs", f"""
SELECT id, CASE WHEN status <> 'partial' THEN started_at ELSE {NOW} END AS started_at,
  CASE WHEN status = 'degraded' THEN NULL ELSE finished_at END AS finished_at,
  CASE WHEN status = 'degraded' THEN 'running' ELSE status END AS status,
  CASE WHEN status = 'degraded' THEN 0 ELSE message_count END AS message_count,
  CASE WHEN status = 'degraded' THEN '' ELSE 'was ' || status END AS error FROM runs""")
def _(t: Tables):
    book = fresh_ledger(t)
    book.record_runs(run_requests(t), now())
    done = t.runs.where(F.col("status") != "degraded").select(
        "id", "finished_at", "status", "message_count",
        F.concat(F.lit("was "), "status").alias("error"))
    book.finish_runs(done.withColumns({"status": F.lit("partial"), "error": F.lit("early")}))
    book.finish_runs(done)
    return book.runs()


def processed(t: Tables):
    return t.classifications.join(t.messages.select(
        "run_id", "account_label", "uid", "is_read", "internal_date"),
        ["run_id", "account_label", "uid"]).select(
        "run_id", "account_label", "uid", "is_read", F.col("label").alias("classification"),
        F.col("summary").alias("digest_excerpt"), F.col("internal_date").alias("processed_at"))


@query("snk_03_record_messages", """
SELECT c.run_id, c.account_label, c.uid, m.is_read, c.label AS classification, c.summary AS digest_excerpt,
  m.internal_date AS processed_at
FROM classifications c JOIN messages m ON m.run_id = c.run_id AND m.account_label = c.account_label AND m.uid = c.uid""")
def _(t: Tables):
    book = fresh_ledger(t)
    rows = processed(t)
    later = rows.withColumns({"classification": F.lit("Ads"), "processed_at": now()})
    book.record_messages(rows.unionByName(later))
    book.record_messages(later)
    return book.read("processed_messages")


@query("snk_04_record_flags", f"""
SELECT account_label, uid, label AS flag, {NOW} AS applied_at FROM classifications WHERE label <> 'Unknown'""")
def _(t: Tables):
    book = fresh_ledger(t)
    rows = flags.flag_plan(t.classifications).select(
        "account_label", "uid", F.col("keyword").alias("flag"), now().alias("applied_at"))
    book.record_flags(rows)
    book.record_flags(rows.withColumn("applied_at", F.col("applied_at") + F.expr("INTERVAL 1 DAY")))
    return book.read("flags_applied")


@query("snk_05_record_digests", """
SELECT id AS run_id, 'file' AS channel, CASE WHEN n = 1 THEN 'failed' ELSE 'sent' END AS status,
  sha256(id || status) AS payload_hash FROM runs CROSS JOIN (SELECT unnest([1, 2]) AS n)""")
def _(t: Tables):
    book = fresh_ledger(t)
    rows = t.runs.select(F.col("id").alias("run_id"), F.lit("file").alias("channel"),
                         F.sha2(F.concat("id", "status"), 256).alias("payload_hash"))
    for status in ("failed", "sent"):  # an append keeps both attempts
        book.record_digests(rows.withColumn("status", F.lit(status)))
    return book.read("digests")


def saved_snapshots(t: Tables) -> Ledger:
    book = fresh_ledger(t)
    header = t.runs.select(F.col("id").alias("run_id"), "finished_at",
                           F.lit(1).cast("bigint").alias("accounts_failed"),
                           F.col("message_count").alias("high_priority_count"))
    labels = t.label_snapshot
    senders = stats.run_level(stats.sender_counts(t.messages), "sender")
    domains = stats.run_level(stats.domain_counts(stats.sender_counts(t.messages)), "domain")
    stale = labels.withColumns({"label": F.lit("Stale"), "n": F.lit(9).cast("bigint")})
    none = labels.withColumns({"label": F.lit("None"), "n": F.lit(0).cast("bigint")})
    book.save_snapshots(header, stale, senders, domains)
    book.save_snapshots(header, labels.unionByName(none), senders, domains)
    return book


@query("snk_06_save_snapshots", f"""
WITH {SENDERS} SELECT 'header' AS kind, id AS run_id, strftime(finished_at, '%Y-%m-%d') AS key, message_count AS n FROM runs
UNION ALL SELECT 'label', run_id, label, n FROM label_snapshot
UNION ALL SELECT 'sender', run_id, sender, count(*) FROM senders WHERE sender <> '' GROUP BY run_id, sender
UNION ALL SELECT 'domain', run_id, domain, count(*) FROM senders WHERE domain <> '' GROUP BY run_id, domain""")
def _(t: Tables):
    book = saved_snapshots(t)
    out = book.snapshot_headers().select(
        F.lit("header").alias("kind"), "run_id", F.date_format("finished_at", "yyyy-MM-dd").alias("key"),
        F.col("high_priority_count").alias("n"))
    for kind in ("label", "sender", "domain"):
        out = out.unionByName(book.snapshot_counts(kind).select(
            F.lit(kind).alias("kind"), "run_id", F.col(kind).alias("key"), "n"))
    return out


@query("snk_07_load_counts", """
SELECT run_id, string_agg(label || '=' || CAST(n AS STRING), ',' ORDER BY label) AS counts
FROM label_snapshot GROUP BY run_id""")
def _(t: Tables):
    stored = saved_snapshots(t).snapshot_counts("label")
    pairs = F.transform(F.map_entries("counts_by_label"),
                        lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return stats.label_map(stored, ["run_id"]).select("run_id", F.array_join(pairs, ",").alias("counts"))


@query("snk_07_counts_of_run", f"""
WITH {SENDERS} SELECT sender, count(*) AS n FROM senders WHERE sender <> '' AND run_id = '2024-01-15-2' GROUP BY sender""")
def _(t: Tables):
    return store.counts_of_run(saved_snapshots(t).snapshot_counts("sender"), "2024-01-15-2")


@query("src_08_ledger_tables", f"""
WITH {SENDERS} SELECT 'runs' AS name, count(*) AS n FROM runs
UNION ALL SELECT 'processed_messages', count(*) FROM classifications
UNION ALL SELECT 'flags_applied', count(*) FROM classifications WHERE label <> 'Unknown'
UNION ALL SELECT 'digests', count(*) FROM runs
UNION ALL SELECT 'run_digest_summaries', count(*) FROM runs
UNION ALL SELECT 'run_digest_label_counts', count(*) FROM label_snapshot
UNION ALL SELECT 'run_digest_sender_counts', count(*) FROM (SELECT DISTINCT run_id, sender FROM senders WHERE sender <> '')
UNION ALL SELECT 'run_digest_domain_counts', count(*) FROM (SELECT DISTINCT run_id, domain FROM senders WHERE domain <> '')""")
def _(t: Tables):
    book = saved_snapshots(t)
    book.record_runs(run_requests(t), now())
    book.record_messages(processed(t))
    book.record_flags(flags.flag_plan(t.classifications).select(
        "account_label", "uid", F.col("keyword").alias("flag"), now().alias("applied_at")))
    book.record_digests(t.runs.select(
        F.col("id").alias("run_id"), F.lit("file").alias("channel"), F.lit("sent").alias("status"),
        F.sha2("id", 256).alias("payload_hash")))
    out = None
    for name in schemas.LEDGER:
        key = re.fullmatch(r"run_digest_(\w+)_counts", name)
        rows = (book.snapshot_counts(key[1]) if key else book.snapshot_headers()
                if name == "run_digest_summaries" else book.read(name))
        part = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out
