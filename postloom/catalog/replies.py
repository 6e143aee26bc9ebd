"""Queries: prompts, replies, validation, repair, provider envelopes, delivery log."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from postloom import fixed
from postloom.catalog import query
from postloom.functions.text import label_list
from postloom.operators import prompts, replies, stats
from postloom.operators.messages import RUN_KEY
from postloom.plans.tables import Tables
from postloom.sources import envelopes

# What the replies hold, from the rules they were made by; no JSON is parsed on this side.
REQUESTS = """
req AS (SELECT *, account_label || '/' || CAST(uid >> 6 AS STRING) AS batch_id, uid >> 6 AS block FROM messages)"""
ITEMS = REQUESTS + """,
its AS (SELECT r.*, attempt, copy, row_number() OVER (PARTITION BY run_id, batch_id, attempt ORDER BY uid, copy) - 1 AS pos
  FROM req r CROSS JOIN (SELECT unnest([0, 1]) AS attempt) a CROSS JOIN (SELECT unnest([1, 2]) AS copy) c
  WHERE CASE attempt WHEN 0 THEN k >= 4 AND (copy = 1 OR k BETWEEN 17 AND 19) ELSE block % 3 <> 0 AND k >= 2 AND copy = 1 END),
errs AS (SELECT *, account_label || '/' || CAST(uid AS STRING) AS ky, unnest(CASE
    WHEN attempt = 1 THEN [NULL]
    WHEN copy = 2 THEN ['duplicate key ' || account_label || '/' || CAST(uid AS STRING)]
    WHEN k BETWEEN 5 AND 9 THEN ['unknown label "Nope" for ' || account_label || '/' || CAST(uid AS STRING)]
    WHEN k BETWEEN 26 AND 28 THEN ['confidence 1.500000 out of range [0,1] for ' || account_label || '/' || CAST(uid AS STRING)]
    WHEN k BETWEEN 20 AND 24 THEN ['invalid priority "urgent" for ' || account_label || '/' || CAST(uid AS STRING)]
    WHEN k BETWEEN 10 AND 14 THEN ['empty summary for ' || account_label || '/' || CAST(uid AS STRING)]
    WHEN k = 15 THEN ['empty key_points for ' || account_label || '/' || CAST(uid AS STRING)]
    WHEN k = 16 THEN ['empty key_points[1] for ' || account_label || '/' || CAST(uid AS STRING),
      'empty key_points[2] for ' || account_label || '/' || CAST(uid AS STRING)]
    ELSE [NULL] END) AS err FROM its),
bat AS (SELECT run_id, batch_id, block, count(*) AS expected, count(*) FILTER (k >= 4) AS listed,
    count(*) FILTER (k >= 2) AS listed_again FROM req GROUP BY run_id, batch_id, block),
doc AS (SELECT *, 0 AS attempt, block % 17 = 0 AS call_failed, CASE WHEN block % 11 = 0 THEN 'parse: invalid JSON'
    WHEN block % 13 = 0 THEN 'parse: unsupported schema_version 2 (max supported: 1)'
    WHEN listed = 0 THEN 'parse: empty classifications array' END AS refused FROM bat
  UNION ALL SELECT *, 1, false, CASE WHEN block % 4 = 1 THEN 'parse: invalid schema_version -1 (must be >= 0)'
    WHEN listed_again = 0 THEN 'parse: empty classifications array' END FROM bat WHERE block % 3 <> 0),
ok AS (SELECT e.* FROM errs e JOIN doc d ON d.run_id = e.run_id AND d.batch_id = e.batch_id AND d.attempt = e.attempt
  WHERE NOT call_failed AND refused IS NULL),
summ AS (SELECT run_id, batch_id, attempt, count(err) AS n_err, count(DISTINCT pos) AS n_all,
    count(*) FILTER (err IS NULL) AS n_valid,
    string_agg('item ' || CAST(pos AS STRING) || ': ' || err, '; ' ORDER BY pos, err) AS detail
  FROM ok GROUP BY run_id, batch_id, attempt),
parsed AS (SELECT d.run_id, d.batch_id, d.attempt, d.block, d.call_failed, d.expected, d.listed, d.listed_again, s.n_err, s.n_all, s.n_valid,
    CASE WHEN d.call_failed THEN NULL WHEN d.refused IS NOT NULL THEN d.refused
      WHEN s.n_err = 0 THEN NULL
      WHEN s.n_valid > 0 THEN 'parse: ' || CAST(n_err AS STRING) || '/' || CAST(n_all AS STRING) || ' items invalid: ' || detail
      ELSE 'parse: all ' || CAST(n_all AS STRING) || ' items invalid: ' || detail END AS parse_error
  FROM doc d LEFT JOIN summ s ON s.run_id = d.run_id AND s.batch_id = d.batch_id AND s.attempt = d.attempt)"""
# The first replies alone, which decide what is asked again.
FIRST = ITEMS + """,
ok0 AS (SELECT * FROM ok WHERE attempt = 0), parsed0 AS (SELECT * FROM parsed WHERE attempt = 0)"""


# First replies and repairs are told apart by their attempt.
REPLY = ["run_id", "batch_id", "attempt"]


def heard(t: Tables):
    return t.replies.where(F.col("reply_error").isNull())


def parsed(t: Tables):
    return replies.parse_replies(heard(t))


@query("json_01_parse_documents", f"""
WITH {ITEMS} SELECT d.run_id, d.batch_id, d.attempt, d.attempt = 0 AND block % 11 = 0 AS malformed,
  CASE WHEN d.attempt = 1 OR block % 11 <> 0 THEN coalesce(i.n, 0) END AS n_items
FROM doc d LEFT JOIN (SELECT run_id, batch_id, attempt, count(*) AS n FROM its GROUP BY run_id, batch_id, attempt) i
  ON i.run_id = d.run_id AND i.batch_id = d.batch_id AND i.attempt = d.attempt WHERE NOT call_failed""")
def _(t: Tables):
    docs = replies.parse_documents(heard(t))
    n = F.when(~F.col("malformed"), F.size("doc.classifications").cast("bigint"))
    return docs.select(*REPLY, "malformed", n.alias("n_items"))


@query("json_02_schema_version", f"""
WITH {ITEMS} SELECT run_id, batch_id, attempt, refused FROM doc WHERE NOT call_failed""")
def _(t: Tables):
    docs = replies.parse_documents(heard(t))
    return docs.select(*REPLY, replies.document_error(
        F.col("raw"), F.col("malformed"), F.col("doc")).alias("refused"))


@query("json_03_invalid_items", f"""
WITH {ITEMS} SELECT run_id, batch_id, attempt, account_label, uid, CAST(pos AS INT) AS pos,
  'item ' || CAST(pos AS STRING) || ': ' || err AS error FROM ok WHERE err IS NOT NULL""")
def _(t: Tables):
    return replies.invalid_items(parsed(t), REPLY)


@query("json_03_valid_items", f"""
WITH {ITEMS} SELECT run_id, batch_id, attempt, account_label, uid, label,
  CASE attempt WHEN 0 THEN CAST(k AS DOUBLE) / 100 ELSE 0.5 END AS confidence, 'r' || CAST(k AS STRING) AS reason,
  CASE attempt WHEN 0 THEN 'summary ' ELSE 'repaired ' END || CAST(uid AS STRING) AS summary,
  CASE attempt WHEN 0 THEN 'p1,p2,p3' ELSE 'p1' END AS key_points, CASE WHEN (attempt = 0 AND k = 25) OR priority = '' THEN 'medium' ELSE priority END AS priority
FROM ok WHERE err IS NULL""")
def _(t: Tables):
    rows = replies.valid_items(parsed(t), REPLY)
    return rows.select(*REPLY, "account_label", "uid", "label", "confidence", "reason",
                       "summary", F.array_join("key_points", ",").alias("key_points"), "priority")


@query("json_04_partial_or_total", f"""
WITH {ITEMS} SELECT run_id, batch_id, attempt, coalesce(n_valid, 0) AS n_valid, CASE
  WHEN parse_error IS NULL THEN 'all valid' WHEN coalesce(n_valid, 0) > 0 THEN 'some valid' ELSE 'none valid' END AS outcome
FROM parsed WHERE NOT call_failed""")
def _(t: Tables):
    good = F.size(F.filter("items", lambda x: F.size(x["errors"]) == 0))
    n = F.greatest(F.coalesce(good, F.lit(0)), F.lit(0)).cast("bigint")
    return parsed(t).select(*REPLY, n.alias("n_valid"), F.when(
        F.col("parse_error").isNull(), F.lit("all valid")).when(n > 0, F.lit("some valid")).otherwise(
        F.lit("none valid")).alias("outcome"))


@query("agg_16_error_rollup", f"""
WITH {ITEMS} SELECT run_id, batch_id, attempt, parse_error FROM parsed WHERE NOT call_failed""")
def _(t: Tables):
    return parsed(t).select(*REPLY, "parse_error")


@query("win_03_duplicate_keys", f"""
WITH {ITEMS} SELECT run_id, batch_id, attempt, account_label, uid, CAST(pos AS INT) AS pos FROM ok WHERE copy = 2""")
def _(t: Tables):
    bad = replies.invalid_items(parsed(t), REPLY)
    return bad.where(F.contains("error", F.lit(": duplicate key "))).drop("error")


@query("json_06_validate_counts", f"""
WITH {ITEMS}, conf AS (SELECT run_id, batch_id, string_agg('item ' || CAST(pos AS STRING) ||
    ': confidence 1.500000 out of range', '; ' ORDER BY pos) AS detail
  FROM its WHERE attempt = 0 AND k BETWEEN 26 AND 28 GROUP BY run_id, batch_id)
SELECT p.run_id, p.batch_id, p.attempt, CASE WHEN n_all IS NULL THEN 'validate: no classifications'
  WHEN n_all <> expected THEN 'validate: expected ' || CAST(expected AS STRING) || ' classifications, got ' || CAST(n_all AS STRING)
  WHEN detail IS NOT NULL THEN 'validate: ' || detail END AS count_error
FROM parsed p LEFT JOIN conf c ON c.run_id = p.run_id AND c.batch_id = p.batch_id AND p.attempt = 0 WHERE NOT call_failed""")
def _(t: Tables):
    expected = t.requests.groupBy("run_id", "batch_id").agg(F.count(F.lit(1)).alias("expected"))
    joined = parsed(t).join(expected, ["run_id", "batch_id"])
    return replies.validate_counts(joined, F.col("expected")).select(
        *REPLY, "count_error")


FALLBACK = FIRST + """,
again AS (SELECT r.* FROM req r JOIN parsed0 p ON p.run_id = r.run_id AND p.batch_id = r.batch_id
  WHERE p.parse_error IS NOT NULL AND r.block % 3 <> 0 AND r.block % 4 <> 1 AND r.k >= 2),
accepted AS (SELECT run_id, account_label, uid, label, CAST(0 AS INT) AS attempt FROM ok0 WHERE err IS NULL
  UNION ALL SELECT a.run_id, a.account_label, a.uid, a.label, CAST(1 AS INT) FROM again a WHERE NOT EXISTS (
    SELECT 1 FROM ok0 o WHERE o.err IS NULL AND o.run_id = a.run_id AND o.account_label = a.account_label AND o.uid = a.uid)),
dead AS (SELECT run_id FROM bat GROUP BY run_id HAVING bool_and(block % 17 = 0)),
rejected AS (SELECT r.run_id, r.account_label, r.uid, CASE
    WHEN p.call_failed THEN 'initial classify: quota exceeded'
    WHEN r.block % 3 = 0 THEN 'repair failed: no reply'
    WHEN r.block % 4 = 1 THEN 'repair produced invalid response: parse: invalid schema_version -1 (must be >= 0)'
    WHEN p.listed_again = 0 THEN 'repair produced invalid response: parse: empty classifications array'
    ELSE 'repair did not produce valid analysis for this item' END AS error,
    CASE WHEN p.call_failed THEN 'classify' ELSE 'repair' END AS stage
  FROM req r JOIN parsed0 p ON p.run_id = r.run_id AND p.batch_id = r.batch_id
  WHERE (p.call_failed OR p.parse_error IS NOT NULL) AND r.run_id NOT IN (SELECT run_id FROM dead)
    AND NOT EXISTS (SELECT 1 FROM accepted a WHERE a.run_id = r.run_id AND a.account_label = r.account_label AND a.uid = r.uid))"""


def fallback(t: Tables, attempts: int = 1):
    wanted = t.requests.select("run_id", "batch_id", "account_label", "uid")
    return replies.partial_fallback(wanted, t.replies, repair_attempts=attempts)


@query("llm_03_accepted", f"WITH {FALLBACK} SELECT run_id, account_label, uid, label, attempt FROM accepted")
def _(t: Tables):
    return fallback(t)[0].select(*RUN_KEY, "label", "attempt")


@query("llm_03_failed", f"WITH {FALLBACK} SELECT run_id, account_label, uid, error, stage FROM rejected")
def _(t: Tables):
    return fallback(t)[1].select(*RUN_KEY, "error", "stage")


@query("llm_04_failed_classification", f"""
WITH {FIRST} SELECT r.run_id, r.account_label, r.uid, 'Unknown' AS label,
  CASE WHEN p.call_failed THEN 'initial classify: quota exceeded' ELSE 'parse/validation failed: ' || p.parse_error END AS error,
  CASE WHEN p.call_failed THEN 'classify' ELSE 'parse' END AS stage
FROM req r JOIN parsed0 p ON p.run_id = r.run_id AND p.batch_id = r.batch_id
WHERE (p.call_failed OR p.parse_error IS NOT NULL)
  AND r.run_id NOT IN (SELECT run_id FROM bat GROUP BY run_id HAVING bool_and(block % 17 = 0))
  AND NOT EXISTS (SELECT 1 FROM ok0 o WHERE o.err IS NULL AND o.run_id = r.run_id
    AND o.account_label = r.account_label AND o.uid = r.uid)""")
def _(t: Tables):
    return fallback(t, attempts=0)[1]


PROMPT = f"""
numbered AS (SELECT m.*, b.body, CAST(floor((row_number() OVER (PARTITION BY m.run_id, m.account_label ORDER BY m.uid) - 1) / 10)
    AS BIGINT) AS batch
  FROM messages m LEFT JOIN bodies b ON b.account_label = m.account_label AND b.uid = m.uid),
blocks AS (SELECT run_id, account_label || '/' || CAST(batch AS STRING) AS batch_id, uid,
  chr(10) || '<<< EMAIL ' || account_label || '/' || CAST(uid AS STRING) || ' >>>' || chr(10) || 'From: ' || from_addr
  || chr(10) || 'Subject: ' || subject || chr(10) || 'Date: ' || strftime(date, '%a, %d %b %Y %H:%M:%S') || ' +0000'
  || chr(10) || 'Status: ' || CASE WHEN is_read THEN 'Read' ELSE 'Unread' END || chr(10) || chr(10) || 'Body:' || chr(10)
  || coalesce(body, '') || chr(10) || '<<< END EMAIL ' || account_label || '/' || CAST(uid AS STRING) || ' >>>' || chr(10) AS block
  FROM numbered)"""


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


HEAD = sql_text(fixed.PROMPT_HEAD.replace("{labels}", "- Useful\n- ToDelete\n- Ads"))


@query("llm_01_prompts", f"""
WITH {PROMPT} SELECT run_id, batch_id, count(*) AS n_messages,
  md5({HEAD} || string_agg(block, '' ORDER BY uid) || {sql_text(fixed.PROMPT_TAIL)}) AS prompt_md5
FROM blocks GROUP BY run_id, batch_id""")
def _(t: Tables):
    made = prompts.build_prompts(prompts.request_batches(t.messages_with_ref), texts=t.texts)
    return made.select("run_id", "batch_id", "n_messages", F.md5("prompt").alias("prompt_md5"))


TEMPLATE = "Pick one of\n{labels}\nfor every mail:{messages}Thanks {labels}"


@query("udf_02_custom_prompt", f"""
WITH {PROMPT} SELECT run_id, batch_id, md5({sql_text('''Pick one of
- A
- B
for every mail:''')} || string_agg(block, '' ORDER BY uid) || {sql_text('''Thanks - A
- B''')}) AS prompt_md5
FROM blocks GROUP BY run_id, batch_id""")
def _(t: Tables):
    made = prompts.build_prompts(prompts.request_batches(t.messages_with_ref), ["A", "B"], TEMPLATE, texts=t.texts)
    return made.select("run_id", "batch_id", F.md5("prompt").alias("prompt_md5"))


REPAIR_TAIL = sql_text(fixed.REPAIR_FORMAT + label_list(fixed.DEFAULT_LABELS) + fixed.REPAIR_RULES)


@query("llm_02_repair_prompts", f"""
SELECT CAST(doc_id AS STRING) AS batch_id, md5({sql_text(fixed.REPAIR_HEAD)} || text || {sql_text(fixed.REPAIR_ERROR)}
  || 'parse: invalid JSON' || {REPAIR_TAIL}) AS prompt_md5 FROM documents""")
def _(t: Tables):
    prose = t.documents.select(F.col("source").alias("run_id"),
                               F.col("doc_id").cast("string").alias("batch_id"), F.col("text").alias("raw"))
    made = replies.repair_prompts(replies.parse_replies(prose))
    return made.select("batch_id", F.md5("prompt").alias("prompt_md5"))


def rule_provider(prompt: str) -> str:
    """A deterministic classifier for tests: read mail is useful, the rest is an ad."""
    import json
    found = re.findall(r"<<< EMAIL (\w+)/(\d+) >>>\nFrom: .*\nSubject: .*\nDate: .*\nStatus: (\w+)\n", prompt)
    items = [{"uid": int(uid), "account": account, "label": "Useful" if status == "Read" else "Ads",
              "confidence": 0.5, "summary": f"{account} {uid}", "key_points": [status]}
             for account, uid, status in found]
    return json.dumps({"schema_version": 1, "classifications": items})


@query("llm_05_user_classifier", """
SELECT run_id, account_label, uid, CASE WHEN is_read THEN 'Useful' ELSE 'Ads' END AS label FROM messages""")
def _(t: Tables):
    made = prompts.build_prompts(prompts.request_batches(t.messages_with_ref), texts=t.texts, parallelism=8)
    answers = prompts.classify(made, rule_provider)
    return replies.valid_items(replies.parse_replies(answers)).select(*RUN_KEY, "label")


ENVELOPES = REQUESTS + """,
env AS (SELECT DISTINCT run_id, batch_id, block, attempt, CASE block % 4 WHEN 0 THEN 'gemini' WHEN 1 THEN 'mistral'
    WHEN 2 THEN 'openrouter' ELSE 'ollama' END AS provider, block % 19 = 0 AS refused, attempt = 0 AND block % 17 = 0 AS blank,
    block % 4 = 3 AND block % 29 = 0 AS unfinished FROM req CROSS JOIN (SELECT unnest([0, 1]) AS attempt) a
  WHERE attempt = 0 OR block % 3 <> 0),
ext AS (SELECT *, CASE WHEN refused THEN provider || '.classify: 429'
    WHEN unfinished THEN provider || '.classify: response not complete'
    WHEN blank THEN provider || CASE WHEN provider = 'gemini' THEN '.classify: empty candidate text' ELSE '.classify: empty response content' END
    WHEN provider = 'gemini' AND block % 23 = 0 THEN provider || '.classify: response blocked by safety filters' END AS reply_error,
  CASE WHEN refused OR unfinished THEN 0 ELSE block % 1000 END AS prompt_tokens,
  CASE WHEN refused OR unfinished THEN 0 ELSE block % 300 END AS completion_tokens FROM env)"""


@query("src_09_reply_envelopes", f"""
WITH {ENVELOPES} SELECT run_id, batch_id, attempt, provider, reply_error, NOT (refused OR unfinished OR blank) AS has_text,
  prompt_tokens, completion_tokens, prompt_tokens + completion_tokens AS total_tokens FROM ext""")
def _(t: Tables):
    done = envelopes.extract_replies(t.raw_replies)
    return done.select(
        *REPLY, "provider",
        F.regexp_replace("reply_error", r"(?s)^(\w+\.classify: [^:]*).*\z", "$1").alias("reply_error"),
        (F.col("raw") != "").alias("has_text"), "prompt_tokens", "completion_tokens", "total_tokens")


@query("json_05_envelope_items", f"""
WITH {ITEMS} SELECT run_id, batch_id, attempt, account_label, uid, label FROM ok
WHERE err IS NULL AND block % 19 <> 0 AND NOT (block % 4 = 3 AND block % 29 = 0)
  AND NOT (block % 4 = 0 AND block % 23 = 0)""")
def _(t: Tables):
    done = envelopes.extract_replies(t.raw_replies).where(F.col("reply_error").isNull())
    return replies.valid_items(replies.parse_replies(done), REPLY).select(
        *REPLY, "account_label", "uid", "label")


@query("agg_14_token_usage", f"""
WITH {ENVELOPES} SELECT run_id, provider, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens FROM ext GROUP BY run_id, provider""")
def _(t: Tables):
    return stats.token_usage(envelopes.extract_replies(t.raw_replies))


@query("json_07_delivery_results", """
SELECT id AS run_id, message_count % 5 = 0 AS ok, CASE message_count % 5
  WHEN 1 THEN 'telegram.send: Too Many Requests: retry after 10 (code 429)'
  WHEN 2 THEN 'telegram.send: chat not found (code 400)'
  WHEN 3 THEN 'telegram.send.unmarshal: invalid JSON'
  WHEN 4 THEN 'telegram.send.request: connection refused' END AS error,
  message_count % 5 IN (1, 4) AS retryable FROM runs""")
def _(t: Tables):
    kind = F.col("message_count") % 5
    body = (F.when(kind == 0, F.lit('{"ok": true, "result": {"message_id": 123}}'))
            .when(kind == 1, F.lit('{"ok": false, "error_code": 429, "description": "Too Many Requests: retry after 10"}'))
            .when(kind == 2, F.lit('{"ok": false, "error_code": 400, "description": "chat not found"}'))
            .when(kind == 3, F.lit("<html>bad gateway</html>")))
    log = t.runs.select(F.col("id").alias("run_id"), F.lit("telegram").alias("channel"),
                        F.lit(1).alias("attempt"), body.alias("body"),
                        F.when(kind == 4, F.lit("connection refused")).alias("transport_error"))
    return envelopes.delivery_results(log).select("run_id", "ok", "error", "retryable")
