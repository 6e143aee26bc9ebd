"""One query per operator, over whole tables with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import (audit, bpe, chat, exact, fingerprints, language, licenses, lines, mixing, neighbours, periods,
                          secrets, simhash)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, table: str, sql: str | None = None):
    """Register an operator of one table as a query."""

    def wrap(fn: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_secret_scan", "documents")
def secret_scan(docs: DataFrame) -> DataFrame:
    return secrets.secret_spans(docs)


@query("op2_mix_sources", "documents")
def mix_sources(docs: DataFrame) -> DataFrame:
    return mixing.mixture(docs)


@query("op3_chat_format", "conversations", r"""
WITH said AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
t AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text,
    '&', '&amp;'), '<|', '&lt;|'), '<s>', '&lt;s>'), '</s>', '&lt;/s>'), '[INST]', '&#91;INST]'), '[/INST]', '&#91;/INST]'),
    '<<SYS>>', '&lt;<SYS>>'), '<</SYS>>', '&lt;</SYS>>'), '<bos>', '&lt;bos>'), '<eos>', '&lt;eos>'),
    '<pad>', '&lt;pad>'), '<unk>', '&lt;unk>') AS escaped FROM said)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length('<|turn|>') + length(role) + 1 + length(escaped) + length('<|end|>') + 1) AS BIGINT) AS formatted_chars,
    CAST(0 AS BIGINT) AS expanded_tokens
FROM t GROUP BY conv_id""")
def chat_format(conversations: DataFrame) -> DataFrame:
    probe = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.conversation_digests(
        conversations.select("conv_id", "turn", "role", "text").unionByName(probe))


@query("op4_fingerprints", "documents")
def document_fingerprints(docs: DataFrame) -> DataFrame:
    return fingerprints.fingerprints(docs)


@query("op5_line_dedup", "documents")
def line_dedup(docs: DataFrame) -> DataFrame:
    return lines.line_digests(docs)


@query("op6_exact_dedup", "documents", r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents),
g AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY plain ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY plain) AS group_size, sha256(plain) AS text_sha256 FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""")
def exact_dedup(docs: DataFrame) -> DataFrame:
    return exact.exact_duplicates(docs)


@query("op7_byte_bpe", "documents")
def byte_bpe(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op8_license_scan", "documents", licenses.brute_force_sql())
def license_scan(docs: DataFrame) -> DataFrame:
    return licenses.license_matches(docs)


@query("op9_simhash_dedup", "documents")
def simhash_dedup(docs: DataFrame) -> DataFrame:
    return simhash.near_duplicates(docs)


@query("op10_language_id", "documents")
def language_id(docs: DataFrame) -> DataFrame:
    return language.predict_languages(docs)


@query("op12_periodic_runs", "documents")
def periodic_runs(docs: DataFrame) -> DataFrame:
    return periods.run_digests(docs)


def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                              spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES["op13_filter_audit"] = filter_audit
ORACLES["op13_filter_audit"] = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT t.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY x) THEN 'E' ELSE '' END AS fails
    FROM t LEFT JOIN (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id) l
    ON l.doc_id = t.doc_id),
g AS (SELECT part, good, toxic, fails, count(*) AS n FROM d GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM f a, f b, f c, f d, f e
    WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT part, filter_order, step, good, toxic, n, contains(fails, filter_order[step]) AS hit, fails = filter_order[step] AS sole,
    regexp_matches(fails, '[' || left(filter_order, step - 1) || '_]') AS gone,
    CASE WHEN contains(fails, filter_order[step]) THEN 120 // length(fails) * n ELSE 0 END AS share
    FROM g, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step))
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN sole THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN hit AND NOT gone AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN hit AND NOT gone AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost,
    CAST(sum(share) AS BIGINT) AS shapley
FROM s GROUP BY part, filter_order, step"""


@query("op11_nearest_neighbours", "embeddings")
def nearest_neighbours(embeddings: DataFrame) -> DataFrame:
    return neighbours.nearest_neighbours(embeddings)
