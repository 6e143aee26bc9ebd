"""Stored provider responses: the reply text, token counts and failure reason of each.

``raw_replies(run_id, batch_id, provider, http_status, body)`` holds four JSON shapes:
candidate lists, chat completions (two providers) and a local model's message.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import fixed

CANDIDATES, LOCAL = "gemini", "ollama"
CHAT = ("mistral", "openrouter")

_SHAPES = {
    "candidates": "candidates array<struct<content:struct<parts:array<struct<text:string>>>,"
                  "finishReason:string>>,"
                  "usageMetadata struct<promptTokenCount:bigint,candidatesTokenCount:bigint,"
                  "totalTokenCount:bigint>,"
                  "promptFeedback struct<blockReason:string>,"
                  "_corrupt_record string",
    "chat": "choices array<struct<message:struct<content:string>>>,"
            "usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>,"
            "_corrupt_record string",
    "local": "message struct<content:string>, done boolean, prompt_eval_count bigint,"
             "eval_count bigint, _corrupt_record string",
}


def _json(shape: str) -> Column:
    return F.from_json("body", _SHAPES[shape], {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("bigint"))


def _candidates() -> tuple[Column, tuple[Column, ...], Column, Column]:
    first = F.get(F.col("candidates.candidates"), F.lit(0))
    text = F.array_join(F.transform(first["content"]["parts"],
                                    lambda p: F.coalesce(p["text"], F.lit(""))), "")
    blocked = F.col("candidates.promptFeedback.blockReason")
    is_blocked = F.coalesce(blocked, F.lit("")) != ""
    failure = (
        F.when(is_blocked, F.concat(F.lit("prompt blocked: "), blocked))
        .when(F.coalesce(F.size("candidates.candidates"), F.lit(0)) <= 0, F.lit("no candidates returned"))
        .when(F.coalesce(text, F.lit("")) == "", F.lit("empty candidate text"))
        .when(first["finishReason"] == "SAFETY", F.lit("response blocked by safety filters")))
    usage = F.col("candidates.usageMetadata")
    return text, (usage["promptTokenCount"], usage["candidatesTokenCount"], usage["totalTokenCount"]), failure, is_blocked


def _chat() -> tuple[Column, tuple[Column, ...], Column, Column]:
    text = F.get(F.col("chat.choices"), F.lit(0))["message"]["content"]
    failure = (
        F.when(F.coalesce(F.size("chat.choices"), F.lit(0)) <= 0, F.lit("no choices in response"))
        .when(F.coalesce(text, F.lit("")) == "", F.lit("empty response content")))
    usage = F.col("chat.usage")
    return text, (usage["prompt_tokens"], usage["completion_tokens"], usage["total_tokens"]), failure, F.lit(False)


def _local() -> tuple[Column, tuple[Column, ...], Column, Column]:
    prompt, answer = _zero(F.col("local.prompt_eval_count")), _zero(F.col("local.eval_count"))
    incomplete = ~F.coalesce("local.done", F.lit(False))
    text = F.col("local.message.content")
    failure = (
        F.when(incomplete, F.lit("response not complete"))
        .when(F.coalesce(text, F.lit("")) == "", F.lit("empty response content")))
    return text, (prompt, answer, prompt + answer), failure, incomplete


def extract_replies(raw_replies: DataFrame) -> DataFrame:
    """``run_id, batch_id, provider, http_status, raw, *_tokens, reply_error`` per response, and ``attempt`` where the
    input has it.

    One projection over one scan; the shape follows from the provider. A response of an unknown
    provider, or of none, stays as a row with a ``reply_error``.
    """
    provider = F.coalesce("provider", F.lit(""))
    shapes = {"candidates": (provider == CANDIDATES, _candidates), "chat": (provider.isin(*CHAT), _chat),
              "local": (provider == LOCAL, _local)}
    df = raw_replies.withColumns({
        name: F.when(is_one, _json(name)) for name, (is_one, _) in shapes.items()})
    status = F.coalesce("http_status", F.lit(0))
    refused = F.concat(provider, F.lit(".classify: "), status.cast("string"), F.lit(": "),
                       F.coalesce("body", F.lit("")))
    text, tokens, error = F.lit(""), [F.lit(0).cast("bigint")] * 3, F.concat(
        F.lit("unknown provider: "), provider)
    for name, (is_one, parts) in shapes.items():
        own, counts, failure, withheld = parts()
        broken = F.col(name).isNull() | F.col(f"{name}._corrupt_record").isNotNull()
        usable = is_one & (status == 200) & ~broken & ~withheld
        text = F.when(usable, F.coalesce(own, F.lit(""))).otherwise(text)
        tokens = [F.when(usable, _zero(n)).otherwise(t) for n, t in zip(counts, tokens)]
        found = (F.when(status != 200, refused)
                 .when(broken, F.concat(provider, F.lit(".classify.unmarshal: invalid JSON")))
                 .otherwise(F.when(failure.isNotNull(), F.concat(provider, F.lit(".classify: "), failure))))
        error = F.when(is_one, found).otherwise(error)
    names = ("prompt_tokens", "completion_tokens", "total_tokens")
    keys = [c for c in ("run_id", "batch_id", "attempt") if c in raw_replies.columns]
    return df.select(*keys, "provider", "http_status", text.alias("raw"),
                     *[t.alias(n) for t, n in zip(tokens, names)], error.alias("reply_error"))


def delivery_results(log: DataFrame) -> DataFrame:
    """Delivery log ``(run_id, channel, attempt, body, transport_error)`` with ok, error, retryable."""
    doc = F.from_json("body", "ok boolean, error_code bigint, description string, "
                              "_corrupt_record string",
                      {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    df = log.withColumn("doc", doc)
    ok = F.coalesce("doc.ok", F.lit(False)) & F.col("transport_error").isNull()
    error = (
        F.when(F.col("transport_error").isNotNull(),
               F.concat("channel", F.lit(".send.request: "), "transport_error"))
        .when(F.col("doc").isNull() | F.col("doc._corrupt_record").isNotNull(),
              F.concat("channel", F.lit(".send.unmarshal: invalid JSON")))
        .when(~ok, F.format_string("%s.send: %s (code %d)", "channel",
                                   F.coalesce("doc.description", F.lit("")),
                                   F.coalesce("doc.error_code", F.lit(0)))))
    out = df.select(*log.columns, ok.alias("ok"), error.alias("error"))
    return out.withColumn("retryable", is_retryable(F.col("error")))


def is_retryable(error: Column) -> Column:
    """Network errors and 429/500/502/503 are worth another try."""
    hits = [F.contains(error, F.lit(t)) for t in fixed.RETRYABLE_TEXT]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))
