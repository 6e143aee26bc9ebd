"""Queries: text functions over whole documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom import fixed
from postloom.catalog import query
from postloom.functions import reply_text, text
from postloom.operators import messages
from postloom.plans.tables import Tables

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160)"


def literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ENTITY_MAP = "MAP {" + ", ".join(f"{literal(f'&{n};')}: {literal(c)}" for n, c in fixed.ENTITIES.items()) + "}"
CODE_POINT = """CASE WHEN lower(substr(tok, 3, 1)) = 'x'
  THEN list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(tok, 4, length(tok) - 4), ''),
    lambda ch: greatest(strpos('0123456789abcdef', lower(ch)) - 1, 0)::BIGINT)), lambda a, d: (a * 16 + d) % 4294967296)
  ELSE list_reduce(list_prepend(0::BIGINT, list_transform(list_filter(string_split(tok, ''), lambda ch: ch BETWEEN '0' AND '9'),
    lambda ch: ch::BIGINT)), lambda a, d: (a * 10 + d) % 4294967296) END"""


def decoded(source: str, key: str, column: str) -> str:
    """Entity decoding in SQL: tokens as rows, decoded one by one, joined in order."""
    return f"""
toks AS (SELECT {key}, unnest(regexp_extract_all({column}, '&[^;]*;|[^&]+|&')) AS tok,
  generate_subscripts(regexp_extract_all({column}, '&[^;]*;|[^&]+|&'), 1) AS pos FROM {source}),
cps AS (SELECT *, CASE WHEN tok LIKE '&#%;' AND length(tok) > 3 THEN {CODE_POINT} END AS cp FROM toks),
outs AS (SELECT {key}, pos, CASE
    WHEN cp > 0 AND cp <= 1114111 AND NOT cp BETWEEN 55296 AND 57343 THEN chr(cp::INT)
    WHEN cp IS NOT NULL THEN tok
    ELSE coalesce({ENTITY_MAP}[tok], tok) END AS out FROM cps),
decoded AS (SELECT {key}, string_agg(out, '' ORDER BY pos) AS text FROM outs GROUP BY {key})"""


def stripped(column: str) -> str:
    """Text of a page in SQL, for pages whose attributes hold no '>': comments, scripts and styles go, then block tags
    become line ends and other tags go; lines are trimmed, empty ones dropped."""
    steps = [r"(?is)<!--.*?(-->|\z)", r"(?is)<(script|style)([^a-z0-9>-][^>]*)?>.*?(</(script|style)[^>]*(>|\z)|\z)"]
    block = "(?is)</?(" + "|".join(fixed.BLOCK_TAGS) + r")([^a-z0-9>-][^>]*)?(>|\z)"
    other = r"(?is)</[^>]*(>|\z)|<[a-z!][^>]*(>|\z)"
    for pattern in steps:
        column = f"regexp_replace({column}, {literal(pattern)}, '', 'g')"
    column = f"regexp_replace(regexp_replace({column}, {literal(block)}, chr(10), 'g'), {literal(other)}, '', 'g')"
    return (f"array_to_string(list_filter(list_transform(string_split({column}, chr(10)), lambda line: trim(line, {WS})), "
            f"lambda line: line <> ''), chr(10))")


def summary(key: str, c):
    return [F.col(key), F.length(c).cast("bigint").alias("n"), F.md5(c).alias("text_md5")]


@query("str_01_strip_html", f"""
SELECT page_id, length(x) AS n, md5(x) AS text_md5 FROM (SELECT page_id, {stripped('html')} AS x FROM pages)""")
def _(t: Tables):
    return t.pages.withColumn("text", text.strip_html(F.col("html"))).select(
        *summary("page_id", F.col("text")))


@query("str_02_tidy_lines", f"""
SELECT doc_id, length(x) AS n, md5(x) AS text_md5 FROM (SELECT doc_id, array_to_string(list_filter(list_transform(
  string_split(replace(text, '.', chr(10) || chr(10)), chr(10)), lambda line: trim(line, {WS})),
  lambda line: line <> ''), chr(10)) AS x FROM documents)""")
def _(t: Tables):
    broken = F.replace("text", F.lit("."), F.lit("\n\n"))
    return t.documents.withColumn("text", text.tidy_lines(broken)).select(
        *summary("doc_id", F.col("text")))


@query("str_02_collapse_newlines", """
SELECT doc_id, length(x) AS n, md5(x) AS text_md5 FROM (
  SELECT doc_id, regexp_replace(replace(text, '. ', chr(10) || chr(10)), chr(10) || '+', chr(10), 'g') AS x
  FROM documents)""")
def _(t: Tables):
    broken = F.replace("text", F.lit(". "), F.lit("\n\n"))
    return t.documents.withColumn("text", text.collapse_newlines(broken)).select(
        *summary("doc_id", F.col("text")))


@query("str_03_strip_control_chars", """
SELECT doc_id, length(x) AS n, md5(x) AS text_md5 FROM (
  SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{7F}-\\x{9F}qz]', '', 'g') AS x
  FROM documents)""")
def _(t: Tables):
    spoiled = F.translate("text", "qz", "\x07\x85")
    return t.documents.withColumn("text", text.strip_control_chars(spoiled)).select(
        *summary("doc_id", F.col("text")))


@query("str_04_decode_entities", f"""
WITH {decoded('pages', 'page_id', 'html')}
SELECT page_id, length(text) AS n, md5(text) AS text_md5 FROM decoded""")
def _(t: Tables):
    return t.pages.withColumn("text", text.decode_entities(F.col("html"))).select(
        *summary("page_id", F.col("text")))


@query("str_04_numeric_entities", f"""
WITH coded AS (SELECT uid, '&#' || CAST(uid * 37 AS STRING) || '; &#x' || to_hex(uid * 11) || ';&copy;&nope;&amp;lt; &'
  || from_addr AS s FROM messages), {decoded('coded', 'uid', 's')}
SELECT uid, length(text) AS n, md5(text) AS text_md5 FROM decoded""")
def _(t: Tables):
    uid = F.col("uid")
    coded = F.concat(F.lit("&#"), (uid * 37).cast("string"), F.lit("; &#x"), F.hex(uid * 11),
                     F.lit(";&copy;&nope;&amp;lt; &"), F.col("from_addr"))
    return t.messages.withColumn("text", text.decode_entities(coded)).select(
        *summary("uid", F.col("text")))


CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{7F}-\x{9F}]"


@query("str_05_sanitize_header", f"""
WITH plain AS (SELECT page_id, regexp_replace({stripped('html')}, '{CONTROLS}', '', 'g') AS s FROM pages),
{decoded('plain', 'page_id', 's')}
SELECT p.page_id, length(x) AS n, md5(x) AS text_md5 FROM (SELECT p.page_id, CASE
    WHEN regexp_matches(html, '[<&\\x00-\\x1F\\x{{7F}}-\\x{{9F}}]') THEN coalesce(trim(d.text, {WS}), '') ELSE trim(html, {WS}) END AS x
  FROM pages p LEFT JOIN decoded d ON d.page_id = p.page_id) p""")
def _(t: Tables):
    return t.pages.withColumn("text", text.sanitize_header(F.col("html"))).select(
        *summary("page_id", F.col("text")))


@query("str_06_sanitize_address", f"""
WITH coded AS (SELECT uid, regexp_replace(from_addr || ' &amp; &lt;x&gt; ' || chr(7), '[\\x00-\\x08]', '', 'g') AS s
  FROM messages), {decoded('coded', 'uid', 's')}
SELECT uid, trim(text, {WS}) AS shown FROM decoded""")
def _(t: Tables):
    coded = F.concat("from_addr", F.lit(" &amp; &lt;x&gt; \x07"))
    return t.messages.select("uid", text.sanitize_address_field(coded).alias("shown"))


@query("str_07_sanitize_body", f"""
SELECT conv_id, turn, md5(regexp_replace(trim(replace(text, 'a', chr(1)), {WS}),
  '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS text_md5 FROM conversations""")
def _(t: Tables):
    spoiled = F.translate("text", "a", "\x01")
    return t.conversations.select("conv_id", "turn", F.md5(text.sanitize_body(spoiled)).alias(
        "text_md5"))


@query("str_08_truncate", """
SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 99) || '…' ELSE text END AS shown FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", text.truncate(F.col("text"), 100).alias("shown"))


@query("str_09_excerpt", """
SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '…' ELSE text END AS shown FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", text.excerpt(F.col("text"), 500).alias("shown"))


@query("str_14_payload_hash", "SELECT doc_id, sha256(text) AS payload_hash FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", text.payload_hash(F.col("text")).alias("payload_hash"))


@query("str_15_strip_fences", f"""
SELECT doc_id, md5(trim(text, {WS})) AS text_md5 FROM documents""")
def _(t: Tables):
    kind = F.col("doc_id") % 3
    fenced = (F.when(kind == 0, F.concat(F.lit(" ```json\n"), "text", F.lit("\n```\nthat is all")))
              .when(kind == 1, F.concat(F.lit("```\n"), "text", F.lit("\n``` ")))
              .otherwise(F.concat("text", F.lit("\n```"))))
    return t.documents.select("doc_id", F.md5(reply_text.strip_fences(fenced)).alias("text_md5"))


@query("str_16_json_part", f"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Here: {{' || text || '}} bye' ELSE text END AS x FROM documents),
p AS (SELECT *, strpos(x, '{{') AS a, strpos(reverse(x), '}}') AS z FROM t)
SELECT doc_id, md5(CASE WHEN a > 0 AND z > 0 AND a < length(x) - z + 1 THEN substr(x, a, length(x) - z + 2 - a)
  ELSE trim(x, {WS}) END) AS text_md5 FROM p""")
def _(t: Tables):
    wrapped = F.when(F.col("doc_id") % 2 == 0, F.concat(
        F.lit("Here: {"), "text", F.lit("} bye"))).otherwise(F.col("text"))
    return t.documents.select("doc_id", F.md5(reply_text.json_part(wrapped)).alias("text_md5"))


@query("str_17_priority", """
SELECT uid, CASE WHEN priority <> '' THEN priority WHEN k < 50 THEN 'medium' ELSE 'soon' END AS effective,
  priority <> '' OR k < 50 AS valid FROM messages""")
def _(t: Tables):
    given = F.when(F.col("priority") != "", F.concat(F.lit(" "), F.upper("priority"))).otherwise(F.lit("  "))
    urgency = F.when(F.col("k") < 50, F.lit("Normal ")).otherwise(F.lit("soon"))
    value = reply_text.effective_priority(given, urgency)
    return t.messages.select("uid", value.alias("effective"),
                             reply_text.valid_priority(value).alias("valid"))


@query("str_18_first_non_blank", """
SELECT uid, CASE WHEN k < 30 THEN subject WHEN k < 60 THEN label ELSE '' END AS picked FROM messages""")
def _(t: Tables):
    one = F.when(F.col("k") < 30, F.col("subject")).otherwise(F.lit(" \t"))
    two = F.when(F.col("k") < 60, F.col("label"))
    return t.messages.select("uid", text.first_non_blank(one, two).alias("picked"))


@query("str_19_priority_rank_text", """
SELECT uid, CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS rank,
  CASE priority WHEN 'high' THEN '🔴 High' WHEN 'medium' THEN '🟡 Medium' WHEN 'low' THEN '🟢 Low'
  ELSE 'Unspecified' END AS shown FROM messages""")
def _(t: Tables):
    loud = F.concat(F.lit(" "), F.initcap("priority"))
    return t.messages.select("uid", messages.priority_rank(loud).alias("rank"),
                             messages.priority_text(loud).alias("shown"))


@query("str_20_badge_plural", """
SELECT uid, CASE WHEN is_read THEN '✅ Read' ELSE '🆕 Unread' END AS badge,
  CASE WHEN k = 1 THEN '' ELSE 's' END AS ending FROM messages""")
def _(t: Tables):
    return t.messages.select("uid", messages.read_badge(F.col("is_read")).alias("badge"),
                             messages.plural(F.col("k")).alias("ending"))


@query("str_21_confidence_percent", """
SELECT uid, printf('%.0f%%', CAST(uid % 1001 AS DOUBLE) / 1000 * 100) AS shown FROM messages""")
def _(t: Tables):
    c = (F.col("uid") % 1001).cast("double") / 1000
    return t.messages.select("uid", messages.confidence_percent(c).alias("shown"))


@query("str_22_clip_error", """
SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 77) || '...' ELSE text END AS shown FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", text.clip_error(F.col("text")).alias("shown"))


@query("str_23_label_lists", """
SELECT run_id, string_agg(label, ', ' ORDER BY label) AS joined,
  '- Useful' || chr(10) || '- ToDelete' || chr(10) || '- Ads' || chr(10) || '- Unknown' AS bulleted
FROM (SELECT DISTINCT run_id, label FROM messages) GROUP BY run_id""")
def _(t: Tables):
    labels = t.messages.groupBy("run_id").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    return labels.select("run_id", text.join_labels(F.col("labels")).alias("joined"),
                         F.lit(text.label_list([])).alias("bulleted"))


@query("str_24_redact", """
SELECT doc_id, md5(replace(replace(replace(text, 'tion.', '[REDACTED]'), 'ab+c', '[REDACTED]'), 'en ', '[REDACTED]')) AS text_md5
FROM documents""")
def _(t: Tables):
    hidden = text.redact(F.col("text"), ["tion.", "ab+c", "en ", ""])
    return t.documents.select("doc_id", F.md5(hidden).alias("text_md5"))


@query("str_25_convert_charset", r"""
SELECT doc_id, md5(CASE WHEN doc_id % 5 = 3 THEN regexp_replace(text, '[^\x00-\x7F]', '', 'g')
  WHEN doc_id % 5 = 4 THEN regexp_replace(text, '[^\x00-\x{FF}]', '', 'g') ELSE text END) AS text_md5 FROM documents""")
def _(t: Tables):
    """Each document through one of five charsets, named by its row."""
    names = ["UTF-8", "UTF-16LE", "UTF-16BE", "us-ascii", "ISO-8859-1"]
    plain = {"us-ascii": r"[^\x00-\x7F]", "ISO-8859-1": r"[^\x00-\xFF]"}
    kind, raw, charset = F.col("doc_id") % 5, F.lit(None).cast("binary"), F.lit(None).cast("string")
    for k, name in enumerate(names):
        kept = F.regexp_replace("text", plain[name], "") if name in plain else F.col("text")
        raw = F.when(kind == k, F.encode(kept, name.upper())).otherwise(raw)
        charset = F.when(kind == k, F.lit(name)).otherwise(charset)
    rows = t.documents.select("doc_id", raw.alias("raw"), charset.alias("charset"))
    return rows.select("doc_id", F.md5(text.convert_charset(F.col("raw"), F.col("charset"))).alias("text_md5"))


@query("set_01_label_set", """
SELECT account_label, uid, label IN ('Useful', 'ToDelete', 'Ads', 'error') OR event_type = 'error' AS known
FROM messages""")
def _(t: Tables):
    name = F.when(F.col("event_type") == "error", F.lit("Alarm")).otherwise(F.col("label"))
    return t.messages.select("account_label", "uid", name.isin(messages.label_set(["Alarm"])).alias(
        "known"))


@query("set_02_accepted_labels", """
SELECT account_label, uid, k >= 10 AS accepted FROM messages""")
def _(t: Tables):
    name = F.when(F.col("k") < 10, F.lit("Nope")).otherwise(F.col("label"))
    accepted = messages.accepted_labels(messages.label_set())
    return t.messages.select("account_label", "uid", name.isin(accepted).alias("accepted"))


@query("udf_01_custom_labels", """
SELECT account_label, uid, event_type AS keyword FROM messages WHERE event_type IN ('error', 'view')""")
def _(t: Tables):
    from postloom.operators import flags
    return flags.flag_plan(t.messages.withColumn("label", F.col("event_type")), ["error", "view"])
