"""Scans, filters and projections over message tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import fixed
from postloom.functions import address, text
from postloom.operators.texts import join_texts

KEY = ["account_label", "uid"]
RUN_KEY = ["run_id", "account_label", "uid"]


def search_window(messages: DataFrame, since: Column, unread_only: bool = False) -> DataFrame:
    """Messages whose internal date is on or after ``since``; optionally unread ones only."""
    out = messages.where(F.col("internal_date") >= since)
    return unread(out) if unread_only else out


def unread(messages: DataFrame) -> DataFrame:
    """Messages not marked as seen."""
    return messages.where(~F.col("is_read"))


def is_read(flags: Column) -> Column:
    """Whether the flag list holds the seen flag."""
    return F.array_contains(flags, fixed.SEEN_FLAG)


def select_folders(messages: DataFrame, accounts: DataFrame,
                   requested: Sequence[str] | None = None) -> DataFrame:
    """Rows of the folders asked for: the request, else the account's list, else the inbox.

    ``accounts`` has one row per account with ``folders ARRAY<STRING>`` (null or empty = default).
    """
    default = F.array(*[F.lit(f) for f in fixed.DEFAULT_FOLDERS])
    own = F.when(F.size("folders") > 0, F.col("folders"))
    wanted = F.array(*[F.lit(f) for f in requested]) if requested else F.coalesce(own, default)
    rows = accounts.select("account_label", F.explode(F.array_distinct(wanted)).alias("folder"))
    return messages.join(rows, ["account_label", "folder"], "left_semi")


def failed_accounts(account_status: DataFrame) -> DataFrame:
    """Accounts whose fetch failed, with the error."""
    return account_status.where(F.col("status") == "error").select(
        "run_id", "account_label", "error")


def drop_failed_accounts(messages: DataFrame, account_status: DataFrame) -> DataFrame:
    """A failed account contributes no row, not even fetched ones."""
    failed = failed_accounts(account_status).select("run_id", "account_label")
    return messages.join(failed, ["run_id", "account_label"], "left_anti")


def assemble(headers: DataFrame, bodies: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Header rows with their bodies; the envelope date wins over the internal date, a missing text is empty.

    With ``texts`` (``body_ref, body``) the bodies are references (``body_ref``), and no text is moved for each row.
    """
    joined = headers.join(bodies, KEY, "left") if texts is None else join_texts(headers, bodies, texts)
    return joined.select(
        *[c for c in headers.columns if c not in ("subject", "from_addr", "envelope_date", "date")],
        F.coalesce(text.sanitize_header(F.col("subject")), F.lit("")).alias("subject"),
        F.coalesce(text.sanitize_address_field(F.col("from_addr")), F.lit("")).alias("from_addr"),
        F.coalesce("envelope_date", "internal_date").alias("date"),
        F.coalesce("body", F.lit("")).alias("body"),
    )


def prompt_inputs(messages: DataFrame) -> DataFrame:
    """The columns a classification request needs."""
    return messages.select(*RUN_KEY, "subject", "from_addr", "date", "body", "is_read")


def label_or_unknown(label: Column) -> Column:
    """The label, or ``Unknown`` when it is missing or empty."""
    return F.coalesce(F.when(label != "", label), F.lit(fixed.UNKNOWN_LABEL))


def normal_priority(priority: Column) -> Column:
    return F.lower(text.trim_space(priority))


def only_high_priority(entries: DataFrame) -> DataFrame:
    return entries.where(normal_priority(F.col("priority")) == "high")


def priority_rank(priority: Column) -> Column:
    p = normal_priority(priority)
    rank = F.when(p == "high", 0).when(p == "medium", 1).when(p == "low", 2)
    return rank.otherwise(3)


def priority_text(priority: Column) -> Column:
    p = normal_priority(priority)
    out = F.lit(fixed.PRIORITY_TEXT_NONE)
    for name, shown in fixed.PRIORITY_TEXT.items():
        out = F.when(p == name, F.lit(shown)).otherwise(out)
    return out


def read_badge(read: Column, shown: bool = True) -> Column:
    if not shown:
        return F.lit("")
    return F.when(read, F.lit(fixed.READ_BADGE)).otherwise(F.lit(fixed.UNREAD_BADGE))


def plural(n: Column) -> Column:
    return F.when(n == 1, F.lit("")).otherwise(F.lit("s"))


def confidence_percent(confidence: Column) -> Column:
    """Whole percent, halves to even as binary floating point formats them."""
    return F.format_string("%.0f%%", F.bround(confidence * 100, 0))


def label_set(custom: Sequence[str] = ()) -> list[str]:
    """Default labels followed by custom ones."""
    return [*fixed.DEFAULT_LABELS, *custom]


def accepted_labels(labels: Sequence[str]) -> list[str]:
    """Labels a reply may use: the given ones and ``Unknown``."""
    return list(dict.fromkeys([*labels, fixed.UNKNOWN_LABEL]))


def with_sender(messages: DataFrame) -> DataFrame:
    """Adds ``sender`` and ``domain``; both empty when the header holds no address."""
    return messages.withColumn("sender", address.sender(F.col("from_addr"))).withColumn(
        "domain", address.sender_domain(F.col("sender")))


def skip_processed(messages: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Messages no earlier run recorded; all of them when reprocessing is forced.

    The key pair is close to unique on both sides, so the anti-join spreads by itself.
    """
    if force:
        return messages
    return messages.join(ledger.select(*KEY), KEY, "left_anti")


def already_processed(keys: DataFrame, ledger: DataFrame) -> DataFrame:
    """The keys an earlier run recorded (or, the other way round, the recorded keys fetched again)."""
    return keys.join(ledger.select(*KEY), KEY, "left_semi")
