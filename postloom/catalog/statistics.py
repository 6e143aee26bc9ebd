"""Queries: statistics, ranking, comparison with the previous run, highlights."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.catalog import query
from postloom.operators import asof, highlights, messages, ranking, stats
from postloom.operators.messages import RUN_KEY
from postloom.plans.tables import Tables
from postloom.plans.triage import run_status

# Sender of a message, written with other functions than the operator uses.
SENDERS = """
addr AS (SELECT *, trim(CASE
    WHEN strpos(f, '<') = 0 THEN f
    WHEN strpos(f, '>') = 0 THEN string_split(f, '<')[-1]
    WHEN strpos(string_split(f, '<')[-1], '>') > 0
      THEN reverse(substr(reverse(string_split(f, '<')[-1]), strpos(reverse(string_split(f, '<')[-1]), '>') + 1))
    ELSE f END) AS address
  FROM (SELECT *, trim(from_addr) AS f FROM messages)),
senders AS (SELECT *, CASE WHEN len(string_split(address, '@')) >= 2 AND string_split(address, '@')[-1] <> ''
    AND length(address) > length(string_split(address, '@')[-1]) + 1 THEN address ELSE '' END AS sender,
  CASE WHEN len(string_split(address, '@')) >= 2 AND string_split(address, '@')[-1] <> ''
    AND length(address) > length(string_split(address, '@')[-1]) + 1
    THEN lower(string_split(address, '@')[-1]) ELSE '' END AS domain
  FROM addr)"""

ENTRIES = """
entries AS (SELECT m.*, coalesce(c.label, f.label, 'Unknown') AS final_label, c.uid IS NOT NULL AS classified,
  c.priority AS final_priority, c.confidence, c.summary, c.reason, f.error, f.stage
FROM messages m
LEFT JOIN classifications c ON c.run_id = m.run_id AND c.account_label = m.account_label AND c.uid = m.uid
LEFT JOIN failed_analyses f ON f.run_id = m.run_id AND f.account_label = m.account_label AND f.uid = m.uid)"""

COUNTS = """count(*) AS fetched, count(*) FILTER (classified) AS classified,
  count(*) FILTER (NOT classified) AS failed, count(*) FILTER (is_read) AS read,
  count(*) FILTER (NOT is_read) AS unread,
  count(*) FILTER (classified AND lower(final_priority) = 'high') AS high_priority,
  count(*) FILTER (error IS NOT NULL) AS analysis_failed"""


def counts(t: Tables):
    return stats.account_counts(t.entries)


def accounts(t: Tables):
    return stats.account_stats(counts(t), t.account_status)


@query("str_10_extract_address", f"WITH {SENDERS} SELECT account_label, uid, address FROM addr")
def _(t: Tables):
    from postloom.functions.address import extract_address
    return t.messages.select("account_label", "uid", extract_address(F.col("from_addr")).alias(
        "address"))


@query("str_11_parse_sender", f"WITH {SENDERS} SELECT account_label, uid, sender, domain FROM senders")
def _(t: Tables):
    return messages.with_sender(t.messages).select("account_label", "uid", "sender", "domain")


@query("agg_01_run_stats", f"""
WITH {ENTRIES}, roster AS (SELECT run_id, count(*) AS accounts_checked,
  count(*) FILTER (status = 'error') AS accounts_failed FROM account_status GROUP BY run_id)
SELECT e.*, r.accounts_checked, r.accounts_failed, r.accounts_checked - r.accounts_failed AS accounts_succeeded
FROM (SELECT run_id, {COUNTS} FROM entries GROUP BY run_id) e JOIN roster r USING (run_id)""")
def _(t: Tables):
    return stats.run_stats(accounts(t)).drop("unrequested")


@query("agg_02_account_stats", f"""
WITH {ENTRIES} SELECT e.*, s.status, s.error
FROM (SELECT run_id, account_label, {COUNTS} FROM entries GROUP BY run_id, account_label) e
JOIN account_status s ON s.run_id = e.run_id AND s.account_label = e.account_label""")
def _(t: Tables):
    return accounts(t)


@query("agg_03_label_counts", f"""
WITH {ENTRIES} SELECT run_id, account_label, final_label AS label, count(*) AS n
FROM entries GROUP BY run_id, account_label, final_label""")
def _(t: Tables):
    return stats.label_counts(t.entries)


@query("agg_04_read_unread", """
SELECT run_id, account_label, count(*) FILTER (is_read) AS read, count(*) FILTER (NOT is_read) AS unread
FROM messages GROUP BY run_id, account_label""")
def _(t: Tables):
    return counts(t).select("run_id", "account_label", "read", "unread")


@query("agg_05_high_priority", f"""
WITH {ENTRIES} SELECT run_id, count(*) FILTER (classified AND lower(final_priority) = 'high') AS high_priority
FROM entries GROUP BY run_id""")
def _(t: Tables):
    return stats.run_stats(accounts(t)).select("run_id", "high_priority")


@query("agg_06_classified_failed", f"""
WITH {ENTRIES} SELECT run_id, account_label, count(*) FILTER (classified) AS classified,
  count(*) FILTER (NOT classified) AS failed FROM entries GROUP BY run_id, account_label""")
def _(t: Tables):
    return counts(t).select("run_id", "account_label", "classified", "failed")


@query("agg_07_analysis_failed", f"""
WITH {ENTRIES} SELECT run_id, account_label, count(*) FILTER (error IS NOT NULL) AS analysis_failed
FROM entries GROUP BY run_id, account_label""")
def _(t: Tables):
    return counts(t).select("run_id", "account_label", "analysis_failed")


@query("agg_08_account_totals", """
SELECT run_id, count(DISTINCT account_label) AS accounts_checked,
  count(*) FILTER (status = 'error') AS accounts_failed,
  count(*) FILTER (status <> 'error') AS accounts_succeeded
FROM account_status GROUP BY run_id""")
def _(t: Tables):
    return stats.run_stats(accounts(t)).select(
        "run_id", "accounts_checked", "accounts_failed", "accounts_succeeded")


@query("agg_09_sender_counts", f"""
WITH {SENDERS} SELECT run_id, account_label, sender, count(*) AS n FROM senders
WHERE sender <> '' GROUP BY run_id, account_label, sender""")
def _(t: Tables):
    return stats.sender_counts(t.messages)


@query("agg_10_domain_counts", f"""
WITH {SENDERS} SELECT run_id, domain, count(*) AS n FROM senders
WHERE domain <> '' GROUP BY run_id, domain""")
def _(t: Tables):
    return stats.run_level(stats.domain_counts(stats.sender_counts(t.messages)), "domain")


@query("agg_13_fill_totals", f"""
WITH {ENTRIES}, per AS (SELECT run_id, final_label, count(*) AS n FROM entries GROUP BY run_id, final_label)
SELECT e.run_id, e.fetched, e.read, e.unread, l.labels FROM (
  SELECT run_id, count(*) AS fetched, count(*) FILTER (is_read) AS read, count(*) FILTER (NOT is_read) AS unread
  FROM entries GROUP BY run_id) e
JOIN (SELECT run_id, string_agg(' ' || final_label || '=' || CAST(n AS STRING), '' ORDER BY final_label) AS labels
  FROM per GROUP BY run_id) l USING (run_id)""")
def _(t: Tables):
    totals = t.runs.select(F.col("id").alias("run_id"), F.col("message_count").alias("total_fetched"),
                           F.lit(0).cast("bigint").alias("fetched"))
    return stats.fill_totals(totals, t.entries).select("run_id", "fetched", "read", "unread", "labels")


@query("agg_15_ingest_failed", """
SELECT r.run_id, coalesce(m.n, 0) AS messages, r.errors, coalesce(m.n, 0) = 0 AND r.errors > 0 AS ingest_failed
FROM (SELECT run_id, count(*) FILTER (status = 'error') AS errors FROM account_status GROUP BY run_id) r
LEFT JOIN (SELECT m.run_id, count(*) AS n FROM messages m JOIN account_status s
  ON s.run_id = m.run_id AND s.account_label = m.account_label WHERE s.status <> 'error'
  GROUP BY m.run_id) m USING (run_id)""")
def _(t: Tables):
    usable = messages.drop_failed_accounts(t.messages, t.account_status)
    return stats.ingest_failed(usable, t.account_status)


@query("win_01_label_order", f"""
WITH {ENTRIES} SELECT run_id, account_label, uid, final_label AS label, row_number() OVER (
  PARTITION BY run_id, final_label ORDER BY
  CASE coalesce(final_priority, '') WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END,
  date DESC, account_label, uid) AS item FROM entries""")
def _(t: Tables):
    rows = t.entries.withColumn("priority", F.coalesce("priority", F.lit("")))
    return ranking.number_entries(rows, ["run_id", "label"]).select(
        *RUN_KEY, "label", "item")


@query("win_02_section_numbers", f"""
WITH {ENTRIES} SELECT run_id, account_label, uid, row_number() OVER (
  PARTITION BY run_id ORDER BY date DESC, account_label, uid) AS item
FROM entries WHERE final_priority = 'high'""")
def _(t: Tables):
    rows = messages.only_high_priority(t.entries)
    return ranking.number_entries(rows, ["run_id"]).select(*RUN_KEY, "item")


@query("win_04_top_senders_per_account", f"""
WITH {SENDERS}, c AS (SELECT run_id, account_label, sender, count(*) AS n FROM senders
  WHERE sender <> '' GROUP BY run_id, account_label, sender),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, account_label ORDER BY n DESC, sender) AS rank FROM c)
SELECT run_id, account_label, sender, n, CAST(rank AS INT) AS rank, sender || ' (' || CAST(n AS STRING) || ')' AS shown
FROM r WHERE rank <= 5""")
def _(t: Tables):
    return stats.top_n(stats.sender_counts(t.messages), ["run_id", "account_label"], "sender")


@query("top_01_most_important", """
SELECT run_id, account_label, uid FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY
  CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, date DESC,
  account_label, uid) AS rn FROM messages) WHERE rn <= 20""")
def _(t: Tables):
    return ranking.most_important(t.messages, 20).select(*RUN_KEY)


@query("top_02_first_fetched", """
SELECT run_id, account_label, uid FROM (SELECT *, row_number() OVER (PARTITION BY run_id
  ORDER BY account_label, uid) AS rn FROM messages) WHERE rn <= 20""")
def _(t: Tables):
    return ranking.first_fetched(t.messages, 20).select(*RUN_KEY)


@query("top_03_top_domains", f"""
WITH {SENDERS}, c AS (SELECT run_id, domain, count(*) AS n FROM senders WHERE domain <> '' GROUP BY run_id, domain),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, domain) AS rank FROM c)
SELECT run_id, string_agg(domain || ' (' || CAST(n AS STRING) || ')', '; ' ORDER BY rank) AS top_domains
FROM r WHERE rank <= 5 GROUP BY run_id""")
def _(t: Tables):
    per_run = stats.run_level(stats.domain_counts(stats.sender_counts(t.messages)), "domain")
    return stats.top_lists(per_run, ["run_id"], "domain", "top").select(
        "run_id", F.array_join("top", "; ").alias("top_domains"))


@query("top_04_list_runs", """
SELECT id, started_at, status, message_count FROM runs ORDER BY started_at DESC, id LIMIT 10""")
def _(t: Tables):
    return ranking.list_runs(t.runs, 0).select("id", "started_at", "status", "message_count")


@query("top_05_last_completed", """
SELECT max(finished_at) AS finished_at FROM runs WHERE status = 'completed'""")
def _(t: Tables):
    return ranking.last_completed(t.runs)


@query("top_06_label_order", f"""
WITH {ENTRIES}, c AS (SELECT run_id, final_label AS label, count(*) AS n FROM entries GROUP BY run_id, final_label)
SELECT run_id, string_agg(label || ':' || CAST(n AS STRING), ',' ORDER BY label) AS labels FROM c GROUP BY run_id""")
def _(t: Tables):
    per_run = stats.run_level(stats.label_counts(t.entries), "label")
    pairs = F.transform(F.map_entries("counts_by_label"),
                        lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return stats.label_map(per_run, ["run_id"]).select(
        "run_id", F.array_join(pairs, ",").alias("labels"))


@query("top_07_head_items", """
SELECT uid, CASE WHEN k % 4 = 0 THEN '' ELSE 'p1' END || CASE WHEN k % 4 >= 2 THEN ',p2' ELSE '' END AS points,
  CASE WHEN k % 4 = 0 THEN '' ELSE 'p1' END || CASE WHEN k % 4 >= 2 THEN ',p2' ELSE '' END
    || CASE WHEN k % 4 >= 3 THEN ',p3' ELSE '' END AS all_points
FROM messages""")
def _(t: Tables):
    items = F.slice(F.array(*[F.lit(p) for p in ("p1", "p2", "p3")]), F.lit(1),
                    (F.col("k") % 4).cast("int"))
    return t.messages.select("uid", F.array_join(ranking.head_items(items, 2), ",").alias("points"),
                             F.array_join(ranking.head_items(items, 0), ",").alias("all_points"))


# Predecessors said as a join of every run with all earlier ones.
PREVIOUS = """
prev AS (SELECT r.id AS run_id, arg_max(p.id, p.finished_at) AS prev_run_id
  FROM runs r LEFT JOIN runs p ON p.status = 'completed' AND p.finished_at < r.finished_at
  GROUP BY r.id)"""


def previous(t: Tables):
    snapshots = t.runs.select(F.col("id").alias("run_id"))
    return asof.previous_runs(t.runs, snapshots)


@query("join_06_previous_run", f"WITH {PREVIOUS} SELECT run_id, prev_run_id FROM prev")
def _(t: Tables):
    return previous(t)


DELTA = f"""
{SENDERS}, {PREVIOUS},
counts AS (SELECT run_id, sender, count(*) AS n FROM senders WHERE sender <> '' GROUP BY run_id, sender),
delta AS (SELECT c.run_id, c.sender, c.n, coalesce(o.n, 0) AS prev_n FROM counts c
  JOIN prev p ON p.run_id = c.run_id AND p.prev_run_id IS NOT NULL
  LEFT JOIN counts o ON o.run_id = p.prev_run_id AND o.sender = c.sender)"""


def run_senders(t: Tables):
    return stats.run_level(stats.sender_counts(t.messages), "sender")


@query("join_07_sender_delta", f"WITH {DELTA} SELECT run_id, sender, n, prev_n FROM delta")
def _(t: Tables):
    now = run_senders(t)
    return asof.count_delta(now, previous(t), now, "sender")


@query("join_09_account_roster", """
SELECT run_id, account_label, CASE WHEN count(*) % 9 = 0 THEN 'error' ELSE 'ok' END AS status,
  count(*) FILTER (k >= 8) AS classified, CASE WHEN count(*) FILTER (k >= 8) = 0 THEN 0 ELSE
  count(*) FILTER (k >= 8) END AS fetched
FROM messages GROUP BY run_id, account_label""")
def _(t: Tables):
    # accounts without any message of the kind still get a zero-filled row
    part = stats.account_counts(t.entries.where("classified"))
    return stats.account_stats(part, t.account_status).select(
        "run_id", "account_label", "status", "classified", "fetched")


@query("hl_01_high_priority", f"""
WITH {ENTRIES}, h AS (SELECT run_id, count(*) FILTER (classified AND final_priority = 'high') AS n
  FROM entries GROUP BY run_id)
SELECT run_id, CAST(n AS STRING) || ' high-priority email' || CASE WHEN n = 1 THEN '' ELSE 's' END
  || ' require attention' AS text FROM h WHERE n > 0""")
def _(t: Tables):
    return highlights.high_priority(stats.run_stats(accounts(t))).select("run_id", "text")


FAILED = """SELECT run_id, 'Account "' || account_label || '" failed: ' ||
  CASE WHEN length(error) > 80 THEN left(error, 77) || '...' ELSE error END AS text
FROM account_status WHERE status = 'error'"""


@query("hl_02_failed_accounts", FAILED)
def _(t: Tables):
    return highlights.failed_accounts(accounts(t)).select("run_id", "text")


ADS = f"""
{PREVIOUS}, ads AS (SELECT run_id, n FROM label_snapshot WHERE label = 'Ads'),
up AS (SELECT c.run_id, 'Advertisements up by ' || CAST(c.n - o.n AS STRING) || ' (was ' || CAST(o.n AS STRING)
    || ', now ' || CAST(c.n AS STRING) || ')' AS text
  FROM ads c JOIN prev p ON p.run_id = c.run_id JOIN ads o ON o.run_id = p.prev_run_id WHERE c.n > o.n)"""


@query("hl_03_ads_increase", f"WITH {ADS} SELECT run_id, text FROM up")
def _(t: Tables):
    return highlights.ads_increase(t.label_snapshot, previous(t), t.label_snapshot).select(
        "run_id", "text")


BURSTS = """SELECT run_id, sender, n, 'Burst from ' || sender || ': ' || CAST(n AS STRING) || ' messages (was '
  || CAST(prev_n AS STRING) || ')' AS text FROM delta WHERE n >= 3 AND n > prev_n"""


@query("hl_04_sender_bursts", f"WITH {DELTA} SELECT run_id, text FROM ({BURSTS})")
def _(t: Tables):
    now = run_senders(t)
    return highlights.sender_bursts(now, previous(t), now).select("run_id", "text")


MORE = f"""
{PREVIOUS}, f AS (SELECT run_id, count(*) FILTER (status = 'error') AS n FROM account_status GROUP BY run_id),
more AS (SELECT c.run_id, 'Account failures increased: ' || CAST(c.n AS STRING) || ' (was ' || CAST(o.n AS STRING)
    || ')' AS text FROM f c JOIN prev p ON p.run_id = c.run_id JOIN f o ON o.run_id = p.prev_run_id
  WHERE c.n > o.n)"""


def header_snapshot(t: Tables):
    return stats.run_stats(accounts(t)).select("run_id", "accounts_failed")


@query("hl_05_more_failures", f"WITH {MORE} SELECT run_id, text FROM more")
def _(t: Tables):
    totals = stats.run_stats(accounts(t))
    return highlights.more_failures(totals, previous(t), header_snapshot(t)).select("run_id", "text")


HIGHLIGHT_LINES = f"""
WITH {ENTRIES}, {DELTA},
ads AS (SELECT run_id, final_label, count(*) AS n FROM entries WHERE final_label = 'Ads' GROUP BY run_id, final_label),
f AS (SELECT run_id, count(*) FILTER (status = 'error') AS n FROM account_status GROUP BY run_id),
h AS (SELECT run_id, count(*) FILTER (classified AND final_priority = 'high') AS n FROM entries GROUP BY run_id),
told AS (
  SELECT run_id, 1 AS kind, 0 AS weight, '' AS key, CAST(n AS STRING) || ' high-priority email'
    || CASE WHEN n = 1 THEN '' ELSE 's' END || ' require attention' AS text FROM h WHERE n > 0
  UNION ALL SELECT run_id, 2, 0, account_label, 'Account "' || account_label || '" failed: ' ||
    CASE WHEN length(error) > 80 THEN left(error, 77) || '...' ELSE error END
    FROM account_status WHERE status = 'error'
  UNION ALL SELECT c.run_id, 3, 0, '', 'Advertisements up by ' || CAST(c.n - o.n AS STRING) || ' (was '
    || CAST(o.n AS STRING) || ', now ' || CAST(c.n AS STRING) || ')'
    FROM ads c JOIN prev p ON p.run_id = c.run_id JOIN ads o ON o.run_id = p.prev_run_id WHERE c.n > o.n
  UNION ALL SELECT run_id, 4, -n, sender, text FROM ({BURSTS})
  UNION ALL SELECT c.run_id, 5, 0, '', 'Account failures increased: ' || CAST(c.n AS STRING) || ' (was '
    || CAST(o.n AS STRING) || ')'
    FROM f c JOIN prev p ON p.run_id = c.run_id JOIN f o ON o.run_id = p.prev_run_id WHERE c.n > o.n),
lines AS (SELECT run_id, kind, weight, key, '- ' || text AS text FROM told
  UNION ALL SELECT id, 0, -1, '', '## Highlights' FROM runs
  UNION ALL SELECT id, 0, 0, '', '— Nothing notable this run.' FROM runs
    WHERE id NOT IN (SELECT run_id FROM told))
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY kind, weight, key) AS pos, text FROM lines"""


@query("hl_06_highlight_list", HIGHLIGHT_LINES)
def _(t: Tables):
    from pyspark.sql import Window

    from postloom.operators import digest
    totals = stats.run_stats(accounts(t))
    labels = stats.run_level(stats.label_counts(t.entries), "label")
    senders = run_senders(t)
    lines = highlights.highlights(totals, accounts(t), labels, senders, previous(t),
                                  header_snapshot(t), labels, senders)
    runs = t.runs.select(F.col("id").alias("run_id"))
    placed = digest.highlight_lines(runs, lines)
    w = Window.partitionBy("run_id").orderBy("grp", "item", "key", "line")
    return placed.select("run_id", F.row_number().over(w).cast("bigint").alias("pos"), "text")


@query("flow_01_run_status", f"""
WITH {ENTRIES}, e AS (SELECT run_id, count(*) AS fetched, count(*) FILTER (classified) AS classified,
  count(*) FILTER (error IS NOT NULL) AS analysis_failed FROM entries GROUP BY run_id),
s AS (SELECT run_id, count(*) FILTER (status = 'error') AS errors FROM account_status GROUP BY run_id)
SELECT r.id AS run_id, CASE
  WHEN e.fetched % 10 = 0 AND s.errors > 0 THEN 'ingest_failed'
  WHEN e.fetched % 10 = 0 THEN 'completed'
  WHEN e.fetched % 10 = 1 OR e.fetched % 10 = 2 OR e.classified = 0 THEN 'degraded'
  WHEN e.analysis_failed > 0 AND e.fetched % 10 < 6 THEN 'partially_classified'
  WHEN s.errors > 0 THEN 'partial' ELSE 'completed' END AS status
FROM runs r JOIN e ON e.run_id = r.id JOIN s ON s.run_id = r.id""")
def _(t: Tables):
    totals = stats.run_stats(accounts(t))
    kind = F.col("fetched") % 10
    facts = totals.select(
        "run_id", F.col("accounts_failed").alias("errors"),
        F.when(kind == 0, 0).otherwise(F.col("fetched")).alias("fetched_raw"),
        F.when(kind == 0, 0).otherwise(F.col("fetched")).alias("fetched"), "classified",
        F.when(kind < 6, F.col("analysis_failed")).otherwise(0).alias("analysis_failed"),
        (kind == 1).alias("classify_failed"), (kind == 2).alias("delivery_failed"))
    return run_status(facts).select("run_id", "status")
