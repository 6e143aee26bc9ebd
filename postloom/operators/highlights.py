"""Highlight lines of a run: ``run_id, kind, weight, key, text``.

The lines stay a long table in (kind, weight, key) order. A run may have any number of senders with
a burst, so the lines are never collected into one list here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import fixed
from postloom.functions.text import clip_error, quoted
from postloom.operators.asof import count_delta
from postloom.operators.messages import plural

KIND_HIGH, KIND_FAILED, KIND_ADS, KIND_BURST, KIND_MORE_FAILED = 1, 2, 3, 4, 5


def _lines(df: DataFrame, kind: int, text: Column, weight: Column | None = None,
           key: Column | None = None) -> DataFrame:
    return df.select(
        "run_id", F.lit(kind).alias("kind"),
        (weight if weight is not None else F.lit(0)).cast("bigint").alias("weight"),
        (key if key is not None else F.lit("")).alias("key"), text.alias("text"))


def high_priority(totals: DataFrame) -> DataFrame:
    n = F.col("high_priority")
    return _lines(totals.where(n > 0), KIND_HIGH, F.concat(
        n.cast("string"), F.lit(" high-priority email"), plural(n), F.lit(" require attention")))


def failed_accounts(accounts: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Account "), quoted(F.col("account_label")), F.lit(" failed: "),
                    clip_error(F.col("error")))
    return _lines(accounts.where(F.col("status") == "error"), KIND_FAILED, text,
                  key=F.col("account_label"))


def ads_increase(labels: DataFrame, previous_of: DataFrame, label_snapshot: DataFrame) -> DataFrame:
    ads = labels.where(F.col("label") == "Ads")
    before = label_snapshot.where((F.col("label") == "Ads") & (F.col("n") > 0))
    delta = count_delta(ads, previous_of, before, "label").where(
        (F.col("n") > F.col("prev_n")) & (F.col("prev_n") > 0))
    return _lines(delta, KIND_ADS, F.format_string(
        "Advertisements up by %d (was %d, now %d)", F.col("n") - F.col("prev_n"), "prev_n", "n"))


def sender_bursts(senders: DataFrame, previous_of: DataFrame,
                  sender_snapshot: DataFrame) -> DataFrame:
    """Senders with three or more messages and more than in the previous run."""
    loud = senders.where(F.col("n") >= fixed.BURST_THRESHOLD)
    delta = count_delta(loud, previous_of, sender_snapshot, "sender").where(
        F.col("n") > F.col("prev_n"))
    text = F.format_string("Burst from %s: %d messages (was %d)", "sender", "n", "prev_n")
    return _lines(delta, KIND_BURST, text, weight=-F.col("n"), key=F.col("sender"))


def more_failures(totals: DataFrame, previous_of: DataFrame, header_snapshot: DataFrame) -> DataFrame:
    before = header_snapshot.select(F.col("run_id").alias("prev_run_id"),
                                    F.col("accounts_failed").alias("prev_failed"))
    now = totals.select("run_id", "accounts_failed").join(previous_of, "run_id")
    joined = now.join(before, "prev_run_id").where(
        F.col("accounts_failed") > F.col("prev_failed"))
    return _lines(joined, KIND_MORE_FAILED, F.format_string(
        "Account failures increased: %d (was %d)", "accounts_failed", "prev_failed"))


def highlights(totals: DataFrame, accounts: DataFrame, labels: DataFrame, senders: DataFrame,
               previous_of: DataFrame, header_snapshot: DataFrame, label_snapshot: DataFrame,
               sender_snapshot: DataFrame) -> DataFrame:
    """All highlight lines."""
    parts = [
        high_priority(totals), failed_accounts(accounts),
        ads_increase(labels, previous_of, label_snapshot),
        sender_bursts(senders, previous_of, sender_snapshot),
        more_failures(totals, previous_of, header_snapshot),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
