"""Queries: digest sections, whole digests, and the full triage pass."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from postloom import schemas
from postloom.catalog import query
from postloom.catalog.replies import FIRST, rule_provider
from postloom.catalog.statistics import (COUNTS, ENTRIES, HIGHLIGHT_LINES, SENDERS, accounts, header_snapshot, previous,
                                         run_senders)
from postloom.operators import digest, highlights, messages, stats
from postloom.operators.messages import RUN_KEY
from postloom.params import DigestOptions, TriageOptions
from postloom.plans import triage as plan
from postloom.plans.run import run_once
from postloom.plans.tables import Tables
from postloom.session import shared_root, stage
from postloom.sources.landing import Landing
from postloom.sources.ledger import Ledger, write_payloads

OPTIONS = DigestOptions()


def run_ids(t: Tables):
    return t.runs.select(F.col("id").alias("run_id"), F.col("finished_at").alias("generated_at"))


def numbered(lines, name: str = "pos"):
    """Lines with their position in the run's section, for comparison."""
    w = Window.partitionBy("run_id").orderBy(*digest.ORDER)
    return lines.select("run_id", F.row_number().over(w).cast("bigint").alias(name), "text")


def totals_with_lists(t: Tables):
    labels = stats.run_level(stats.label_counts(t.entries), "label")
    domains = stats.run_level(stats.domain_counts(stats.sender_counts(t.messages)), "domain")
    return digest.with_lists(stats.run_stats(accounts(t)), ["run_id"], labels, run_senders(t), domains)


def accounts_with_lists(t: Tables):
    return digest.with_lists(
        accounts(t), ["run_id", "account_label"], stats.label_counts(t.entries),
        stats.sender_counts(t.messages), stats.domain_counts(stats.sender_counts(t.messages)))


def top(table: str, group: str, key: str) -> str:
    """SQL: the top five of a key per group as one text of list lines."""
    return f"""
{table} AS (SELECT {group}, string_agg('- ' || {key} || ' (' || CAST(n AS STRING) || ')', chr(10) ORDER BY rn) AS lines
  FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY n DESC, {key}) AS rn FROM (
    SELECT {group}, {key}, count(*) AS n FROM senders WHERE {key} <> '' GROUP BY {group}, {key})) WHERE rn <= 5
  GROUP BY {group})"""


def label_line(table: str, group: str) -> str:
    return f"""
{table} AS (SELECT {group}, string_agg(' ' || final_label || '=' || CAST(n AS STRING), '' ORDER BY final_label) AS labels
  FROM (SELECT {group}, final_label, count(*) AS n FROM entries GROUP BY {group}, final_label) GROUP BY {group})"""


SUMMARY = f"""
WITH {ENTRIES}, {SENDERS}, {top('ts', 'run_id', 'sender')}, {top('td', 'run_id', 'domain')}, {label_line('ll', 'run_id')},
c AS (SELECT run_id, {COUNTS} FROM entries GROUP BY run_id),
a AS (SELECT run_id, count(*) AS checked, count(*) FILTER (status = 'error') AS bad FROM account_status GROUP BY run_id)
SELECT c.run_id, '## Summary' || chr(10) || chr(10) || '**Fetched:** ' || CAST(fetched AS STRING) || chr(10)
  || '**Classified:** ' || CAST(classified AS STRING) || chr(10) || '**Failed:** ' || CAST(failed AS STRING) || chr(10)
  || '**Accounts:** ' || CAST(checked AS STRING) || ' checked, ' || CAST(checked - bad AS STRING) || ' succeeded, '
  || CAST(bad AS STRING) || ' failed' || chr(10) || '**High priority:** ' || CAST(high_priority AS STRING) || chr(10)
  || '**Read:** ' || CAST(read AS STRING) || chr(10) || '**Unread:** ' || CAST(unread AS STRING) || chr(10)
  || '**Labels:**' || labels || coalesce(chr(10) || '**Top senders:**' || chr(10) || ts.lines, '')
  || coalesce(chr(10) || '**Noisiest domains:**' || chr(10) || td.lines, '') || chr(10)
  || '**Messages:** ' || CAST(fetched AS STRING) || ' classified (' || CAST(fetched AS STRING) || ' fetched, '
  || CAST(failed AS STRING) || ' failed)' AS payload
FROM c JOIN a USING (run_id) JOIN ll USING (run_id) LEFT JOIN ts USING (run_id) LEFT JOIN td USING (run_id)"""


@query("dig_02_summary", SUMMARY)
def _(t: Tables):
    totals = totals_with_lists(t).withColumn("total_messages", F.col("fetched"))
    return assembled(digest.summary_lines(totals, OPTIONS)).select("run_id", "payload")


ACCOUNTS = f"""
WITH {ENTRIES}, {SENDERS}, {top('ts', 'run_id, account_label', 'sender')}, {top('td', 'run_id, account_label', 'domain')},
{label_line('ll', 'run_id, account_label')},
c AS (SELECT run_id, account_label, {COUNTS} FROM entries GROUP BY run_id, account_label),
one AS (SELECT c.run_id, account_label, '### ' || account_label || chr(10) || chr(10) || '**Fetched:** '
  || CAST(fetched AS STRING) || ' | **Classified:** ' || CAST(classified AS STRING) || ' | **Failed:** '
  || CAST(failed AS STRING) || chr(10) || '**Read:** ' || CAST(read AS STRING) || ' | **Unread:** ' || CAST(unread AS STRING)
  || chr(10) || '**Labels:**' || labels || coalesce(chr(10) || '**Top senders:**' || chr(10) || ts.lines, '')
  || coalesce(chr(10) || '**Noisiest domains:**' || chr(10) || td.lines, '')
  || CASE WHEN s.error <> '' THEN chr(10) || '⚠️ **Fetch error:** ' || s.error ELSE '' END AS block
  FROM c JOIN account_status s USING (run_id, account_label) JOIN ll USING (run_id, account_label)
  LEFT JOIN ts USING (run_id, account_label) LEFT JOIN td USING (run_id, account_label))
SELECT run_id, '## Account Stats' || chr(10) || string_agg(block, chr(10) ORDER BY account_label) AS payload
FROM one GROUP BY run_id"""


@query("dig_03_account_stats", ACCOUNTS)
def _(t: Tables):
    lines = digest.account_lines(run_ids(t), accounts_with_lists(t), OPTIONS)
    return assembled(lines).select("run_id", "payload")


SHOWN = f"""
{ENTRIES},
ranked AS (SELECT *, CASE coalesce(final_priority, '') WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS pr
  FROM entries),
shown AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pr, date DESC, account_label, uid) AS place
  FROM ranked) WHERE place <= 100)"""
ENTRY_HEAD = """'### ' || CAST(n AS STRING) || '. ' || subject || chr(10) || chr(10) || '**From:** ' || from_addr
  || ' | **Date:** ' || strftime(date, '%Y-%m-%d %H:%M') || chr(10) || '**Status:** '
  || CASE WHEN is_read THEN '✅ Read' ELSE '🆕 Unread' END"""
ENTRY_PRIORITY = """chr(10) || '**Priority:** ' || CASE pr WHEN 0 THEN '🔴 High' WHEN 1 THEN '🟡 Medium'
  WHEN 2 THEN '🟢 Low' ELSE 'Unspecified' END"""


def shown_entries(t: Tables):
    """The capped entries, stored: sections read them more than once."""
    return stage(digest.capped_entries(t.entries_with_excerpt, OPTIONS), "shown")


def assembled(lines):
    """One text per run from stored lines."""
    return digest.assemble(stage(lines, "lines"))


ATTENTION = f"""
WITH {SHOWN}, h AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY date DESC, account_label, uid) AS n
  FROM shown WHERE pr = 0)
SELECT run_id, '## 🚨 Needs Attention' || chr(10) || string_agg({ENTRY_HEAD} || {ENTRY_PRIORITY}
  || chr(10) || '**Reason:** ' || coalesce(reason, ''), chr(10) ORDER BY n) || chr(10) || '---' AS payload
FROM h GROUP BY run_id"""


@query("dig_04_needs_attention", ATTENTION)
def _(t: Tables):
    return assembled(digest.attention_lines(shown_entries(t), OPTIONS)).select("run_id", "payload")


LABEL_SECTIONS = f"""
WITH {SHOWN}, e AS (SELECT s.*, b.body, row_number() OVER (PARTITION BY run_id, final_label
    ORDER BY pr, date DESC, account_label, uid) AS n
  FROM shown s LEFT JOIN bodies b USING (account_label, uid)),
sec AS (SELECT run_id, final_label, chr(10) || '## ' || final_label || ' (' || CAST(count(*) AS STRING) || ')' || chr(10)
  || string_agg({ENTRY_HEAD} || {ENTRY_PRIORITY} || chr(10) || '**Confidence:** '
    || printf('%.0f%%', coalesce(confidence, 0) * 100) || chr(10) || '**Reason:** ' || coalesce(reason, '') || chr(10)
    || CASE WHEN summary IS NOT NULL THEN '**Summary:** ' || summary || chr(10) || chr(10) || '**Key points:**' || chr(10)
      || '- first point' || chr(10) || '- point of ' || CAST(uid AS STRING)
      || CASE WHEN final_priority = 'high' THEN chr(10) || chr(10) || '**Action items:**' || chr(10) || '- answer' ELSE '' END
    WHEN error IS NOT NULL THEN '⚠️ **Analysis failed (' || stage || '):** ' || error || chr(10) || '> '
      || CASE WHEN length(coalesce(body, '')) > 500 THEN left(body, 500) || '…' ELSE coalesce(body, '') END
    ELSE '> ' || CASE WHEN length(coalesce(body, '')) > 500 THEN left(body, 500) || '…' ELSE coalesce(body, '') END END,
    chr(10) ORDER BY n) AS block
  FROM e GROUP BY run_id, final_label)
SELECT run_id, string_agg(block, chr(10) ORDER BY final_label) AS payload FROM sec GROUP BY run_id"""


@query("dig_05_label_sections", f"WITH text AS ({LABEL_SECTIONS}) SELECT run_id, md5(payload) AS payload_md5 FROM text")
def _(t: Tables):
    lines = digest.label_lines(shown_entries(t), OPTIONS)
    return assembled(lines).select("run_id", F.md5("payload").alias("payload_md5"))


def main_lines(t: Tables, options: DigestOptions = OPTIONS):
    """All digest lines; the tables that many lines read are written once."""
    rows = stage(t.entries_with_excerpt, "entries")
    per_account = stage(accounts_with_lists(t), "accounts")
    totals = stage(totals_with_lists(t), "totals")
    labels = stage(stats.run_level(stats.label_counts(rows), "label"), "labels")
    senders = stage(run_senders(t), "senders")
    notable = stage(highlights.highlights(
        totals, per_account, labels, senders, previous(t), totals, labels, senders), "highlights")
    lines = digest.markdown_lines(run_ids(t), totals, per_account, rows, notable, options)
    return stage(lines, "lines")


@query("dig_01_markdown_document", f"""
WITH summary AS ({SUMMARY.replace("'**Messages:** ' || CAST(fetched AS STRING)", "'**Messages:** ' || CAST(least(fetched, 100) AS STRING)")}),
per_account AS ({ACCOUNTS}), attention AS ({ATTENTION}), sections AS ({LABEL_SECTIONS}), told AS ({HIGHLIGHT_LINES}),
notable AS (SELECT run_id, string_agg(text, chr(10) ORDER BY pos) AS payload FROM told GROUP BY run_id),
text AS (SELECT r.id AS run_id, '# 📧 Email Digest' || chr(10) || chr(10) || '**Run ID:** ' || r.id || chr(10)
    || '**Generated:** ' || strftime(r.finished_at, '%Y-%m-%d %H:%M') || chr(10) || n.payload || chr(10) || s.payload || chr(10)
    || a.payload || coalesce(chr(10) || t.payload, '') || chr(10) || l.payload || chr(10) || chr(10) || '---' || chr(10) || chr(10)
    || '*Generated by postloom*' || chr(10) AS payload
  FROM runs r JOIN notable n ON n.run_id = r.id JOIN summary s ON s.run_id = r.id JOIN per_account a ON a.run_id = r.id
  LEFT JOIN attention t ON t.run_id = r.id JOIN sections l ON l.run_id = r.id)
SELECT run_id, strlen(payload) AS bytes, sha256(payload) AS payload_hash FROM text""")
def _(t: Tables):
    return digest.assemble(main_lines(t)).select("run_id", "bytes", "payload_hash")


@query("dig_01_line_table")
def _(t: Tables):
    return main_lines(t).select("run_id", *digest.ORDER, "text")


FALLBACK_TEXT = f"""
WITH {SENDERS}, {top('ts', 'run_id', 'sender')}, {top('td', 'run_id', 'domain')},
f AS (SELECT m.*, b.body, row_number() OVER (PARTITION BY m.run_id ORDER BY m.account_label, m.uid) AS n
  FROM messages m LEFT JOIN bodies b ON b.account_label = m.account_label AND b.uid = m.uid),
l AS (SELECT run_id, count(*) AS shown, string_agg({ENTRY_HEAD} || chr(10) || chr(10) || '> '
    || CASE WHEN length(coalesce(body, '')) > 500 THEN left(body, 500) || '…' ELSE coalesce(body, '') END, chr(10) ORDER BY n) AS list
  FROM f WHERE n <= 100 GROUP BY run_id),
per_account AS ({ACCOUNTS}),
c AS (SELECT run_id, count(*) AS fetched, count(*) FILTER (is_read) AS read FROM messages GROUP BY run_id)
SELECT r.id AS run_id, '# ⚠️ Email Digest (Fallback)' || chr(10) || chr(10) || '**Run ID:** ' || r.id || chr(10)
  || '**Generated:** ' || strftime(r.finished_at, '%Y-%m-%d %H:%M') || chr(10)
  || '**Status:** ⚠️ LLM classification was unavailable — messages are listed without labels.' || chr(10) || chr(10) || '---' || chr(10)
  || '## Summary' || chr(10) || chr(10) || '**Fetched:** ' || CAST(fetched AS STRING) || chr(10) || '**Classified:** 0' || chr(10)
  || '**Failed:** ' || CAST(fetched AS STRING) || chr(10) || '**Accounts:** 0 checked, 0 succeeded, 0 failed' || chr(10)
  || '**High priority:** 0' || chr(10) || '**Read:** ' || CAST(read AS STRING) || chr(10) || '**Unread:** '
  || CAST(fetched - read AS STRING) || chr(10) || '**Labels:** Unknown=' || CAST(fetched AS STRING)
  || coalesce(chr(10) || '**Top senders:**' || chr(10) || ts.lines, '')
  || coalesce(chr(10) || '**Noisiest domains:**' || chr(10) || td.lines, '') || chr(10) || a.payload || chr(10) || chr(10) || '---' || chr(10) || chr(10)
  || '## Fetched Messages (' || CAST(shown AS STRING) || ')' || chr(10) || list || chr(10) || chr(10) || '---' || chr(10) || chr(10)
  || '*Generated by postloom (fallback mode)*' || chr(10) AS payload
FROM runs r JOIN per_account a ON a.run_id = r.id JOIN c ON c.run_id = r.id JOIN l ON l.run_id = r.id
LEFT JOIN ts ON ts.run_id = r.id LEFT JOIN td ON td.run_id = r.id"""


def fallback_document(t: Tables):
    """Lines of the digest of runs whose classification failed, with the accounts as they are known."""
    rows = stage(t.messages_with_excerpt.withColumns({
        "label": F.lit("Unknown"), "priority": F.lit("")}), "rows")
    unknown = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("fetched"),
                                         F.count_if("is_read").alias("read"))
    zero = F.lit(0).cast("bigint")
    totals = unknown.withColumns({
        "classified": zero, "failed": F.col("fetched"), "unread": F.col("fetched") - F.col("read"),
        "high_priority": zero, "accounts_checked": zero, "accounts_succeeded": zero,
        "accounts_failed": zero})
    labels = stats.run_level(stats.label_counts(rows), "label")
    domains = stats.run_level(stats.domain_counts(stats.sender_counts(rows)), "domain")
    listed = digest.with_lists(totals, ["run_id"], labels, run_senders(t), domains)
    return digest.fallback_lines(run_ids(t), listed, accounts_with_lists(t), rows, OPTIONS)


@query("dig_06_fallback_document", f"WITH text AS ({FALLBACK_TEXT}) SELECT run_id, md5(payload) AS payload_md5 FROM text")
def _(t: Tables):
    return assembled(fallback_document(t)).select("run_id", F.md5("payload").alias("payload_md5"))


@query("snk_08_payload_files", f"""
WITH text AS ({FALLBACK_TEXT}) SELECT run_id, md5(payload || chr(10)) AS files_md5 FROM text""")
def _(t: Tables):
    """Whole digests written as text files, one folder a run, and read back file by file."""
    path = f"{shared_root(t.spark)}/payloads/{uuid.uuid4().hex}"
    write_payloads(stage(fallback_document(t), "lines"), path)
    files = (t.spark.read.schema("value string, run_id string").text(path, wholetext=True)
             .select("run_id", F.struct(F.col("_metadata.file_name").alias("name"), "value").alias("file")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("file")), lambda f: f["value"]), "")
    return files.groupBy("run_id").agg(F.md5(text).alias("files_md5"))


def run_pass(t: Tables, options: TriageOptions = TriageOptions()):
    labels = stage(stats.run_level(stats.label_counts(t.entries), "label"), "labels")
    return plan.triage(
        t.messages_with_known_ref, t.requests.select("run_id", "batch_id", "account_label", "uid"), t.replies,
        t.account_status, t.runs, t.processed_messages, stage(header_snapshot(t), "headers"), labels,
        stage(run_senders(t), "senders"), options, texts=t.texts)


# The fallback rules of the replies: all replies are read, and judge the messages that are left when accounts that failed
# and messages that earlier runs recorded are taken out.
TRIAGED = FIRST + """,
usable AS (SELECT r.* FROM req r WHERE NOT EXISTS (SELECT 1 FROM account_status s WHERE s.status = 'error'
    AND s.run_id = r.run_id AND s.account_label = r.account_label)),
fresh AS (SELECT r.* FROM usable r WHERE NOT EXISTS (SELECT 1 FROM processed_messages p
    WHERE p.account_label = r.account_label AND p.uid = r.uid)),
asked AS (SELECT DISTINCT run_id, batch_id FROM fresh),
accepted AS (SELECT run_id, account_label, uid, label FROM ok0 WHERE err IS NULL
  UNION ALL SELECT r.run_id, r.account_label, r.uid, r.label FROM req r
    JOIN parsed0 p ON p.run_id = r.run_id AND p.batch_id = r.batch_id JOIN asked a ON a.run_id = r.run_id AND a.batch_id = r.batch_id
    WHERE p.parse_error IS NOT NULL AND r.block % 3 <> 0 AND r.block % 4 <> 1 AND r.k >= 2 AND NOT EXISTS (SELECT 1 FROM ok0 o
      WHERE o.err IS NULL AND o.run_id = r.run_id AND o.account_label = r.account_label AND o.uid = r.uid)),
dead AS (SELECT a.run_id FROM asked a JOIN parsed0 p ON p.run_id = a.run_id AND p.batch_id = a.batch_id
  GROUP BY a.run_id HAVING bool_and(p.call_failed)),
rejected AS (SELECT r.run_id, r.account_label, r.uid, CASE
    WHEN p.call_failed THEN 'initial classify: quota exceeded'
    WHEN r.block % 3 = 0 THEN 'repair failed: no reply'
    WHEN r.block % 4 = 1 THEN 'repair produced invalid response: parse: invalid schema_version -1 (must be >= 0)'
    WHEN p.listed_again = 0 THEN 'repair produced invalid response: parse: empty classifications array'
    ELSE 'repair did not produce valid analysis for this item' END AS error,
    CASE WHEN p.call_failed THEN 'classify' ELSE 'repair' END AS stage
  FROM fresh r JOIN parsed0 p ON p.run_id = r.run_id AND p.batch_id = r.batch_id
  WHERE (p.call_failed OR p.parse_error IS NOT NULL) AND r.run_id NOT IN (SELECT run_id FROM dead)
    AND NOT EXISTS (SELECT 1 FROM accepted a WHERE a.run_id = r.run_id AND a.account_label = r.account_label AND a.uid = r.uid)),
fin AS (SELECT r.run_id, r.account_label, r.uid, coalesce(a.label, 'Unknown') AS label, a.uid IS NOT NULL AS classified,
    j.error, j.stage
  FROM fresh r LEFT JOIN accepted a ON a.run_id = r.run_id AND a.account_label = r.account_label AND a.uid = r.uid
  LEFT JOIN rejected j ON j.run_id = r.run_id AND j.account_label = r.account_label AND j.uid = r.uid)"""


@query("flow_03_triage_entries", f"""
WITH {TRIAGED} SELECT run_id, account_label, uid, label, classified, error, stage FROM fin""")
def _(t: Tables):
    return run_pass(t).entries.select(*RUN_KEY, "label", "classified", "error", "stage")


@query("flow_03_fresh_entries", f"WITH {TRIAGED} SELECT run_id, account_label, uid FROM fin")
def _(t: Tables):
    """The pass over a ledger that knows messages: none of them is an entry again."""
    return run_pass(t).entries.select(*RUN_KEY)


# Valid replies that name no message of the pass count as classified for the run.
@query("flow_03_triage_pass", f"""
WITH {TRIAGED},
n AS (SELECT run_id, count(*) AS fetched, count(*) FILTER (error IS NOT NULL) AS analysis_failed FROM fin GROUP BY run_id),
v AS (SELECT run_id, count(*) AS classified FROM accepted GROUP BY run_id),
u AS (SELECT run_id, count(*) AS raw FROM usable GROUP BY run_id),
e AS (SELECT run_id, count(*) FILTER (status = 'error') AS errors FROM account_status GROUP BY run_id),
s AS (SELECT r.id, e.errors, coalesce(u.raw, 0) AS raw, coalesce(n.fetched, 0) AS fetched, coalesce(v.classified, 0) AS classified,
    coalesce(n.analysis_failed, 0) AS analysis_failed, dead.run_id IS NOT NULL AS classify_failed
  FROM runs r JOIN e ON e.run_id = r.id LEFT JOIN u ON u.run_id = r.id LEFT JOIN n ON n.run_id = r.id
  LEFT JOIN v ON v.run_id = r.id LEFT JOIN dead ON dead.run_id = r.id)
SELECT id, CASE WHEN raw = 0 AND errors > 0 THEN 'ingest_failed' WHEN fetched = 0 THEN 'completed'
    WHEN classify_failed OR classified = 0 THEN 'degraded' WHEN analysis_failed > 0 THEN 'partially_classified'
    WHEN errors > 0 THEN 'partial' ELSE 'completed' END AS status, fetched AS message_count,
  CASE WHEN raw = 0 AND errors > 0 THEN 'all ' || CAST(errors AS STRING) || ' account(s) failed to fetch messages'
    ELSE '' END AS error, CASE WHEN fetched > 0 THEN 'sent' END AS digest
FROM s""")
def _(t: Tables):
    """The whole pass with all sinks written; the final run states and digest records."""
    result = run_pass(t)
    book = opened_ledger(t)
    plan.record(result, book, f"{book.root}/payloads", closed_at())
    sent = book.read("digests").select(F.col("run_id").alias("id"), F.col("status").alias("digest"))
    return book.runs().join(sent, "id", "left").select(
        "id", "status", "message_count", "error", "digest")


@query("udf_03_user_interfaces", """
SELECT account_label || '/' || CAST(uid AS STRING) || ' ' || CASE WHEN is_read THEN 'Useful' ELSE 'Ads' END AS line FROM messages""")
def _(t: Tables):
    """A whole run with the user's own source (a landing table), classifier and renderer; the lines it rendered."""
    base = f"{shared_root(t.spark)}/users/{uuid.uuid4().hex}"
    rows = t.messages_with_body.select("account_label", "uid", "folder", "subject", "from_addr", "internal_date", "date",
                                       "is_read", "body")
    landing = Landing(t.spark, f"{base}/landed", rows.schema)
    landing.write(rows)

    def renderer(runs, totals, accounts, entries, notable, options):
        text = F.concat("account_label", F.lit("/"), F.col("uid").cast("string"), F.lit(" "), "label")
        return entries.select("run_id", F.lit(0).alias("section"), F.col("account_label").alias("grp"),
                              F.col("uid").alias("item"), F.lit("").alias("key"), F.lit(0).alias("line"), text.alias("text"))

    result = run_once(t.spark, Ledger(t.spark, f"{base}/ledger"), landing.ingest(), rule_provider, f"{base}/payloads",
                      now=dt.datetime(2024, 2, 1), window_hours=24 * 366, renderer=renderer, parallelism=8)
    return result.lines.select(F.col("text").alias("line"))


def closed_at():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


def opened_ledger(t: Tables) -> Ledger:
    """A new ledger in which every run is open."""
    book = Ledger(t.spark, f"{shared_root(t.spark)}/ledgers/{uuid.uuid4().hex}")
    book.record_runs(t.runs.select("id", "started_at", F.lit("").alias("status")), closed_at())
    return book


@query("flow_02_dry_run_writes_nothing", """
SELECT 'runs' AS name, id, 'running' AS status, CAST(0 AS BIGINT) AS n FROM runs
UNION ALL SELECT unnest(['processed_messages', 'flags_applied', 'digests', 'run_digest_summaries', 'run_digest_label_counts',
  'run_digest_sender_counts', 'run_digest_domain_counts', 'payloads']), '', '', CAST(0 AS BIGINT)""")
def _(t: Tables):
    """Every table and the payload folder behind a dry run: the open runs, and nothing else."""
    options = TriageOptions(dry_run=True)
    book = opened_ledger(t)
    plan.record(run_pass(t, options), book, f"{book.root}/payloads", closed_at(), options)
    out = book.runs().select(F.lit("runs").alias("name"), "id", "status", F.col("message_count").alias("n"))
    for name in schemas.LEDGER:
        if name != "runs":
            out = out.unionByName(book.read(name).agg(F.count(F.lit(1)).alias("n")).select(
                F.lit(name).alias("name"), F.lit("").alias("id"), F.lit("").alias("status"), "n"))
    written = len(book.versions.files("payloads"))
    return out.unionByName(t.spark.range(1).select(
        F.lit("payloads").alias("name"), F.lit("").alias("id"), F.lit("").alias("status"), F.lit(written).cast("bigint").alias("n")))
