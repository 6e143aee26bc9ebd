"""Parsing, validation, repair and merging of classifier replies.

A reply is one row with one JSON text. Its items are checked with array expressions inside that
row, so parsing needs no shuffle; only accepted or rejected items are exploded into rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom import fixed
from postloom.functions.reply_text import (effective_priority, json_part, strip_fences,
                                           valid_priority)
from postloom.functions.text import first_non_blank, label_list, quoted, trim_space
from postloom.operators.messages import RUN_KEY, accepted_labels
from postloom.session import stage

BATCH = ["run_id", "batch_id"]
_CORRUPT = "_corrupt_record"
_STRINGS = T.ArrayType(T.StringType())

_TEXTS = ("account", "label", "reason", "summary", "priority", "urgency")
_LISTS = ("key_points", "action_items")
_FIELDS = ("uid", "account", "label", "confidence", "reason", "summary", "key_points", "action_items", "priority", "urgency")
# Fields are kept as parsed, so that their JSON types can be told; a number of another type is no number here.
_RAW_ITEM = T.StructType([T.StructField(name, T.VariantType()) for name in _FIELDS])
_RAW_DOCUMENT = T.StructType([
    T.StructField("schema_version", T.LongType()),
    T.StructField("classifications", T.ArrayType(_RAW_ITEM)),
])
# The text is parsed as the only element of an array with its hash behind it: a text that closes the
# array itself, or that is followed by anything, loses that mark.
_WRAPPED = T.StructType([
    T.StructField("docs", T.ArrayType(_RAW_DOCUMENT)), T.StructField("end", T.LongType()),
    T.StructField(_CORRUPT, T.StringType())])


def _typed(item: Column) -> Column:
    """An item with its fields as Spark types, and whether one has a wrong JSON type or the uid is out of range."""
    kinds = {name: F.coalesce(F.schema_of_variant(item[name]), F.lit("VOID")) for name in _FIELDS}
    fits = kinds["uid"].isin("VOID", "BIGINT") & kinds["confidence"].rlike("^(VOID|BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    for name in _TEXTS:
        fits = fits & kinds[name].isin("VOID", "STRING")
    for name in _LISTS:
        fits = fits & kinds[name].isin("VOID", "ARRAY<VOID>", "ARRAY<STRING>")
    types = dict.fromkeys(_TEXTS, "string") | dict.fromkeys(_LISTS, "array<string>") | {
        "uid": "bigint", "confidence": "double"}
    values = {name: F.try_variant_get(item[name], "$", types[name]) for name in _FIELDS}
    in_range = F.coalesce(values["uid"], F.lit(0)).between(0, fixed.MAX_UID)
    return F.struct(*[values[name].alias(name) for name in _FIELDS], (~(fits & in_range)).alias("refused"))


def parse_documents(replies: DataFrame) -> DataFrame:
    """Adds ``doc``, the parsed document, and ``malformed``. Each text is parsed once.

    The steps are columns of their own: expressions over lists are evaluated where they stand, and would repeat
    the parse in each place.
    """
    found = replies.withColumn("_document", strip_fences(F.col("raw"))).withColumn("_document", json_part(F.col("_document")))
    marked = found.withColumn("_mark", F.xxhash64("_document"))
    wrapped = F.concat(F.lit('{"docs":['), "_document", F.lit('],"end":'), F.col("_mark").cast("string"), F.lit("}"))
    parsed = marked.withColumn("_parsed", F.from_json(wrapped, _WRAPPED, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT,
        "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}))
    first = F.get(F.col("_parsed.docs"), F.lit(0))
    typed = parsed.withColumn("doc", F.when(first.isNotNull(), F.struct(
        first["schema_version"].alias("schema_version"),
        F.transform(first["classifications"], _typed).alias("classifications"))))
    malformed = (F.col("_parsed").isNull() | F.col(f"_parsed.{_CORRUPT}").isNotNull()
                 | (F.size("_parsed.docs") != 1) | ~F.col("_parsed.end").eqNullSafe(F.col("_mark"))
                 | F.coalesce(F.exists("doc.classifications", lambda x: x["refused"]), F.lit(False)))
    return typed.withColumn("malformed", malformed).drop("_document", "_mark", "_parsed")


def document_error(raw: Column, malformed: Column, doc: Column) -> Column:
    """Why the whole document is refused, or null."""
    version = F.coalesce(doc["schema_version"], F.lit(0))
    return (
        F.when(trim_space(F.coalesce(raw, F.lit(""))) == "", F.lit("parse: empty response"))
        .when(malformed, F.lit("parse: invalid JSON"))
        .when(version < 0, F.format_string(
            "parse: invalid schema_version %d (must be >= 0)", version))
        .when(version > fixed.SCHEMA_VERSION, F.format_string(
            f"parse: unsupported schema_version %d (max supported: {fixed.SCHEMA_VERSION})", version))
        .when(F.coalesce(F.size(doc["classifications"]), F.lit(0)) <= 0,
              F.lit("parse: empty classifications array"))
    )


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _numbered_items(doc: Column) -> Column:
    """Items with their position and with missing fields filled."""
    return F.transform(doc["classifications"], lambda x, i: F.struct(
        i.alias("pos"), _text(x["account"]).alias("account"),
        F.coalesce(x["uid"], F.lit(0)).alias("uid"), _text(x["label"]).alias("label"),
        F.coalesce(x["confidence"], F.lit(0.0)).alias("confidence"),
        _text(x["reason"]).alias("reason"), _text(x["summary"]).alias("summary"),
        F.transform(F.coalesce(x["key_points"], F.array().cast(_STRINGS)), _text).alias("key_points"),
        F.transform(F.coalesce(x["action_items"], F.array().cast(_STRINGS)), _text).alias(
            "action_items"),
        _text(x["priority"]).alias("given_priority"), _text(x["urgency"]).alias("urgency"),
        effective_priority(_text(x["priority"]), _text(x["urgency"])).alias("priority")))


def _first_flags(items: Column) -> Column:
    """Per item whether its key occurs for the first time: sort by key, compare neighbours, sort back."""
    keys = F.array_sort(F.transform(items, lambda x: F.struct(
        x["account"].alias("account"), x["uid"].alias("uid"), x["pos"].alias("pos"))))
    nothing = F.lit(None).cast("struct<account:string,uid:bigint,pos:int>")
    shifted = F.concat(F.array(nothing), keys)
    pairs = F.zip_with(keys, shifted, lambda this, before: F.struct(
        this["pos"].alias("pos"),
        (~(this["account"].eqNullSafe(before["account"])
           & this["uid"].eqNullSafe(before["uid"]))).alias("first")))
    # the shifted copy is one longer; its surplus pair has no position
    return F.array_sort(F.filter(pairs, lambda p: p["pos"].isNotNull()))


def _item_errors(x: Column, first: Column, labels: list[str]) -> Column:
    """Errors of one item in check order; only the first failing check reports."""
    item = F.concat(F.lit("item "), x["pos"].cast("string"), F.lit(": "))
    key = F.concat(x["account"], F.lit("/"), x["uid"].cast("string"))
    blank_points = F.filter(
        F.transform(x["key_points"], lambda p, j: F.when(trim_space(p) == "", F.concat(
            item, F.lit("empty key_points["), j.cast("string"), F.lit("] for "), key))),
        lambda e: e.isNotNull())

    def one(*parts: Column) -> Column:
        return F.array(F.concat(item, *parts))

    return (
        F.when(~first, one(F.lit("duplicate key "), key))
        .when(~x["label"].isin(labels),
              one(F.lit("unknown label "), quoted(x["label"]), F.lit(" for "), key))
        .when(~x["confidence"].between(0.0, 1.0),
              one(F.lit("confidence "), F.format_string("%f", x["confidence"]),
                  F.lit(" out of range [0,1] for "), key))
        .when((x["priority"] != "") & ~valid_priority(x["priority"]),
              one(F.lit("invalid priority "),
                  quoted(first_non_blank(x["given_priority"], x["urgency"])), F.lit(" for "), key))
        .when(trim_space(x["summary"]) == "", one(F.lit("empty summary for "), key))
        .when(F.size(x["key_points"]) == 0, one(F.lit("empty key_points for "), key))
        .otherwise(blank_points)
    )


def parse_replies(replies: DataFrame, labels: Sequence[str] = fixed.DEFAULT_LABELS) -> DataFrame:
    """Adds ``items`` (each with its ``errors``) and ``parse_error`` (null when all is valid).

    ``replies`` needs a ``raw`` text column; its other columns are kept.
    """
    accepted = accepted_labels(labels)
    docs = parse_documents(replies)
    refused = docs.withColumn(
        "refused", document_error(F.col("raw"), F.col("malformed"), F.col("doc")))
    listed = refused.withColumn(
        "_items", F.when(F.col("refused").isNull(), _numbered_items(F.col("doc")))
    ).drop("doc", "malformed")
    zipped = F.arrays_zip(F.col("_items"), F.col("_firsts"))
    checked = listed.withColumn("_firsts", _first_flags(F.col("_items"))).withColumn(
        "items", F.transform(zipped, lambda z: z["_items"].withField(
            "errors", _item_errors(z["_items"], z["_firsts"]["first"], accepted)))
    ).drop("_items", "_firsts")
    errors = F.flatten(F.transform("items", lambda x: x["errors"]))
    counted = checked.withColumn("_errors", errors)
    n_bad, n_all = F.size("_errors"), F.size("items")
    n_valid = F.size(F.filter("items", lambda x: F.size(x["errors"]) == 0))
    detail = F.array_join("_errors", "; ")
    summary = F.when(n_bad == 0, F.lit(None).cast("string")).when(
        n_valid > 0, F.concat(F.lit("parse: "), n_bad.cast("string"), F.lit("/"),
                              n_all.cast("string"), F.lit(" items invalid: "), detail)
    ).otherwise(F.concat(F.lit("parse: all "), n_all.cast("string"), F.lit(" items invalid: "),
                         detail))
    return counted.withColumn(
        "parse_error", F.when(F.col("refused").isNotNull(), F.col("refused")).otherwise(summary)
    ).drop("refused", "_errors")


def valid_items(parsed: DataFrame, keep: Sequence[str] = BATCH) -> DataFrame:
    """Accepted items as classification rows."""
    good = F.filter("items", lambda x: F.size(x["errors"]) == 0)
    return parsed.select(*keep, F.explode(good).alias("i")).select(
        *keep, F.col("i.account").alias("account_label"), "i.uid", "i.label", "i.confidence",
        "i.reason", "i.summary", "i.key_points", "i.action_items", "i.priority", "i.urgency",
        "i.pos")


def invalid_items(parsed: DataFrame, keep: Sequence[str] = BATCH) -> DataFrame:
    """Rejected items with one row per error."""
    bad = F.filter("items", lambda x: F.size(x["errors"]) > 0)
    return parsed.select(*keep, F.explode(bad).alias("i")).select(
        *keep, F.col("i.account").alias("account_label"), "i.uid", "i.pos",
        F.explode("i.errors").alias("error"))


def validate_counts(parsed: DataFrame, expected: Column) -> DataFrame:
    """Adds ``count_error``: the plain list check of a reply's items against an expected count."""
    size = F.coalesce(F.size("items"), F.lit(0))

    def item_errors(x: Column) -> Column:
        item = F.concat(F.lit("item "), x["pos"].cast("string"), F.lit(": "))
        key = F.concat(x["account"], F.lit("/"), x["uid"].cast("string"))
        no_label = F.when(x["label"] == "", F.concat(item, F.lit("empty label for "), key))
        bad_conf = F.when(~x["confidence"].between(0.0, 1.0), F.concat(
            item, F.lit("confidence "), F.format_string("%f", x["confidence"]),
            F.lit(" out of range")))
        return F.array_compact(F.array(no_label, bad_conf))

    errors = F.flatten(F.transform("items", item_errors))
    return parsed.withColumn(
        "count_error",
        F.when(size <= 0, F.lit("validate: no classifications"))
        .when((expected > 0) & (size != expected), F.format_string(
            "validate: expected %d classifications, got %d", expected, size))
        .when(F.size(errors) > 0, F.concat(F.lit("validate: "), F.array_join(errors, "; "))))


def missing_analyses(requests: DataFrame, valid: DataFrame) -> DataFrame:
    """Requested keys without a valid item."""
    return requests.join(valid.select(*RUN_KEY), RUN_KEY, "left_anti")


def first_pass_wins(valid: DataFrame, repaired: DataFrame) -> DataFrame:
    """First-pass items, and repaired items for the other keys: one row per key.

    One aggregation on the key does the merge and also settles a key that two replies answer.
    """
    value = [c for c in valid.columns if c not in RUN_KEY]
    both = valid.withColumn("attempt", F.lit(0)).unionByName(
        repaired.withColumn("attempt", F.lit(1)))
    order = F.struct("attempt", *[c for c in ("batch_id", "pos") if c in value])
    return both.groupBy(*RUN_KEY).agg(
        F.min_by(F.struct(*value, "attempt"), order).alias("v")).select(*RUN_KEY, "v.*")


def repair_prompts(parsed: DataFrame, labels: Sequence[str] = fixed.DEFAULT_LABELS) -> DataFrame:
    """Repair prompt per reply with an error; a blank reply or one without error gives none."""
    bad = parsed.where(F.col("parse_error").isNotNull() & (trim_space(F.col("raw")) != ""))
    prompt = F.concat(
        F.lit(fixed.REPAIR_HEAD), F.col("raw"), F.lit(fixed.REPAIR_ERROR), F.col("parse_error"),
        F.lit(fixed.REPAIR_FORMAT + label_list(labels) + fixed.REPAIR_RULES))
    return bad.select(*BATCH, prompt.alias("prompt"))


def partial_fallback(requests: DataFrame, replies: DataFrame,
                     labels: Sequence[str] = fixed.DEFAULT_LABELS,
                     repair_attempts: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accept what is valid, repair once, mark the rest: ``(valid, failed, batches)``.

    ``requests``: one row per requested key with ``batch_id``. ``replies``: ``run_id, batch_id,
    attempt`` (0 first reply, 1 repair), ``raw`` and ``reply_error`` (the call failed). ``batches``
    has one row per batch with ``call_error`` and ``parse_error`` of the first reply.

    The parsed replies and the accepted items are written once to the shared folder: several
    branches read them, and JSON is parsed a single time.
    """
    if repair_attempts not in (0, 1):
        raise ValueError("repair_attempts must be 0 or 1")
    parsed = stage(parse_replies(
        replies.where(F.col("attempt") <= F.lit(repair_attempts)), labels).select(
        *BATCH, "attempt", "reply_error", "items", "parse_error"), "parsed")
    heard = F.col("reply_error").isNull()
    first = parsed.where((F.col("attempt") == 0) & heard)
    again = parsed.where((F.col("attempt") == 1) & heard)

    def of(attempt: int, value: Column) -> Column:
        return F.when(F.col("attempt") == attempt, value)

    calls = parsed.groupBy(*BATCH).agg(
        F.count(of(0, F.lit(1))).alias("answers"), F.count(of(1, F.lit(1))).alias("repairs"),
        F.max(of(0, F.col("reply_error"))).alias("call_error"),
        F.max(of(1, F.col("reply_error"))).alias("repair_call_error"),
        F.max(of(0, F.when(heard, F.col("parse_error")))).alias("parse_error"),
        F.max(of(1, F.when(heard, F.col("parse_error")))).alias("repair_error"))
    batches = (
        requests.select(*BATCH).distinct()
        .join(calls, BATCH, "left")
        .withColumn("call_error", F.when(F.coalesce("answers", F.lit(0)) == 0, F.lit("no reply"))
                    .otherwise(F.col("call_error")))
    )
    in_doubt = batches.where(F.col("parse_error").isNotNull()).select(*BATCH)
    clean = again.where(F.col("parse_error").isNull()).join(in_doubt, BATCH, "left_semi")
    valid = stage(first_pass_wins(valid_items(first), valid_items(clean)), "valid")
    by_run = batches.groupBy("run_id").agg(
        F.bool_and(F.col("call_error").isNotNull()).alias("run_failed"))
    troubled = batches.where(F.col("parse_error").isNotNull() | F.col("call_error").isNotNull()).join(by_run.where(~F.col("run_failed")).select("run_id"), ["run_id"], "left_semi")
    failed = mark_failed(missing_analyses(requests, valid).join(troubled, BATCH), repair_attempts)
    return valid, failed, batches


def mark_failed(missing: DataFrame, repair_attempts: int = 1) -> DataFrame:
    """``Unknown`` rows with error and stage for requested keys of a batch in trouble."""
    if repair_attempts == 0:
        error = F.concat(F.lit("parse/validation failed: "), "parse_error")
        stage = F.lit("parse")
    else:
        error = (
            F.when(F.coalesce("repairs", F.lit(0)) == 0, F.lit("repair failed: no reply"))
            .when(F.col("repair_call_error").isNotNull(),
                  F.concat(F.lit("repair failed: "), "repair_call_error"))
            .when(F.col("repair_error").isNotNull(),
                  F.concat(F.lit("repair produced invalid response: "), "repair_error"))
            .otherwise(F.lit("repair did not produce valid analysis for this item")))
        stage = F.lit("repair")
    no_call = F.col("call_error").isNotNull()
    return missing.select(
        *RUN_KEY, F.lit(fixed.UNKNOWN_LABEL).alias("label"),
        F.when(no_call, F.concat(F.lit("initial classify: "), "call_error")).otherwise(error).alias(
            "error"),
        F.when(no_call, F.lit("classify")).otherwise(stage).alias("stage"))
