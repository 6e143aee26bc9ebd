"""Per-run and per-account statistics.

Counts are taken once per (run, account[, key]) with map-side partial aggregation; run totals add
up those small tables instead of reading the messages again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom import fixed
from postloom.functions import address
from postloom.operators.messages import RUN_KEY, label_or_unknown

CLASSIFICATION = ["label", "confidence", "reason", "summary", "key_points", "action_items",
                  "priority"]
COUNTS = ["fetched", "classified", "failed", "read", "unread", "high_priority", "analysis_failed"]


def entries(messages: DataFrame, valid: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row per message with its classification, if any.

    ``classified`` tells a valid classification; ``error`` and ``stage`` describe a failed analysis.
    """
    results = valid.select(*RUN_KEY, *CLASSIFICATION, F.lit(True).alias("classified"))
    if failed is not None:
        results = results.unionByName(
            failed.select(*RUN_KEY, "label", "error", "stage", F.lit(False).alias("classified")),
            allowMissingColumns=True)
    else:
        results = results.withColumns({"error": F.lit(None).cast("string"),
                                       "stage": F.lit(None).cast("string")})
    kept = [c for c in messages.columns if c not in CLASSIFICATION]
    joined = messages.select(*kept).join(results, RUN_KEY, "left")
    return joined.withColumns({
        "label": label_or_unknown(F.col("label")),
        "classified": F.coalesce("classified", F.lit(False)),
    })


def _is_high() -> Column:
    return F.col("classified") & (F.lower("priority") == "high")


def account_counts(rows: DataFrame) -> DataFrame:
    """Message counts per run and account."""
    return rows.groupBy("run_id", "account_label").agg(
        F.count(F.lit(1)).alias("fetched"),
        F.count_if("classified").alias("classified"),
        F.count_if(~F.col("classified")).alias("failed"),
        F.count_if("is_read").alias("read"),
        F.count_if(~F.col("is_read")).alias("unread"),
        F.count_if(_is_high()).alias("high_priority"),
        F.count_if(F.col("error").isNotNull()).alias("analysis_failed"),
    )


def account_stats(counts: DataFrame, account_status: DataFrame) -> DataFrame:
    """Counts for every account checked or seen, zero-filled, with fetch status and error.

    ``account_status`` has one row per run and account.
    """
    roster = account_status.select("run_id", "account_label", "status", "error")
    joined = roster.join(counts, ["run_id", "account_label"], "full_outer")
    return joined.select(
        "run_id", "account_label",
        F.when(F.col("status") == "error", F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        F.coalesce("error", F.lit("")).alias("error"),
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in COUNTS],
    )


def run_stats(accounts: DataFrame, unrequested: DataFrame | None = None) -> DataFrame:
    """Run totals from the account rows.

    Valid replies to keys nobody asked for count as classified for the run, not for an account.
    """
    totals = accounts.groupBy("run_id").agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        F.count(F.lit(1)).alias("accounts_checked"),
        F.count_if(F.col("status") == "error").alias("accounts_failed"),
    ).withColumn("accounts_succeeded", F.col("accounts_checked") - F.col("accounts_failed"))
    if unrequested is None:
        return totals.withColumn("unrequested", F.lit(0).cast("bigint"))
    extra = unrequested.groupBy("run_id").agg(F.count(F.lit(1)).alias("unrequested"))
    joined = totals.join(extra, "run_id", "left").fillna({"unrequested": 0})
    return joined.withColumn("classified", F.col("classified") + F.col("unrequested"))


def unrequested_replies(valid: DataFrame, messages: DataFrame) -> DataFrame:
    """Valid replies whose key is no message of the run."""
    return valid.join(messages.select(*RUN_KEY), RUN_KEY, "left_anti")


def counts_by(rows: DataFrame, key: str) -> DataFrame:
    """Rows per (run, account, key value); empty values are left out."""
    return rows.where(F.col(key) != "").groupBy("run_id", "account_label", key).agg(
        F.count(F.lit(1)).alias("n"))


def run_level(counts: DataFrame, key: str) -> DataFrame:
    """Per-run counts from per-account counts."""
    return counts.groupBy("run_id", key).agg(F.sum("n").alias("n"))


def sender_counts(messages: DataFrame) -> DataFrame:
    """Messages per run, account and sender; headers without an address are left out."""
    found = messages.select("run_id", "account_label",
                            F.explode(address.senders(F.col("from_addr"))).alias("sender"))
    return found.groupBy("run_id", "account_label", "sender").agg(F.count(F.lit(1)).alias("n"))


def domain_counts(senders: DataFrame) -> DataFrame:
    """Messages per run, account and domain, summed from the sender counts."""
    named = senders.withColumn("domain", address.sender_domain(F.col("sender")))
    return named.groupBy("run_id", "account_label", "domain").agg(F.sum("n").alias("n"))


def label_counts(rows: DataFrame) -> DataFrame:
    return counts_by(rows, "label")


def top_n(counts: DataFrame, group: list[str], key: str, n: int = fixed.TOP_SENDERS) -> DataFrame:
    """The ``n`` largest counts per group, ties by key, with their rank and text.

    The rank filter lets Spark keep only ``n`` rows per group and task before the shuffle.
    """
    w = Window.partitionBy(*group).orderBy(F.desc("n"), F.asc(key))
    return (
        counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
        .withColumn("shown", F.format_string("%s (%d)", F.col(key), F.col("n")))
    )


def top_lists(counts: DataFrame, group: list[str], key: str, name: str,
              n: int = fixed.TOP_SENDERS) -> DataFrame:
    """The shown texts of ``top_n`` as one ordered list per group (at most ``n`` long)."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", "shown")))
    return top_n(counts, group, key, n).groupBy(*group).agg(
        F.transform(ranked, lambda r: r["shown"]).alias(name))


def label_map(counts: DataFrame, group: list[str]) -> DataFrame:
    """Label counts as one sorted map per group; its size is that of the label set."""
    pairs = F.sort_array(F.collect_list(F.struct("label", "n")))
    return counts.groupBy(*group).agg(F.map_from_entries(pairs).alias("counts_by_label"))


def label_text(counts: DataFrame, group: list[str]) -> DataFrame:
    """Label counts as `` a=1 b=2`` per group."""
    pairs = F.sort_array(F.collect_list(F.struct("label", "n")))
    parts = F.transform(pairs, lambda p: F.format_string(" %s=%d", p["label"], p["n"]))
    return counts.groupBy(*group).agg(F.array_join(parts, "").alias("labels"))


def fill_totals(stats: DataFrame, rows: DataFrame) -> DataFrame:
    """Render-time totals: zero totals and absent label counts are recounted from the rows.

    ``stats`` holds ``run_id, total_fetched, fetched`` and the result adds read, unread and labels.
    """
    recount = rows.groupBy("run_id").agg(
        F.count_if("is_read").alias("read"), F.count_if(~F.col("is_read")).alias("unread"))
    labels = label_text(run_level(label_counts(rows), "label"), ["run_id"])
    fetched = F.when((F.col("fetched") == 0) & (F.col("total_fetched") > 0),
                     F.col("total_fetched")).otherwise(F.col("fetched"))
    return (
        stats.withColumn("fetched", fetched).join(recount, "run_id", "left")
        .join(labels, "run_id", "left")
    )


def ingest_failed(messages: DataFrame, account_status: DataFrame) -> DataFrame:
    """Per run: no message left and at least one account failed."""
    n = messages.groupBy("run_id").agg(F.count(F.lit(1)).alias("messages"))
    bad = account_status.groupBy("run_id").agg(
        F.count_if(F.col("status") == "error").alias("errors"))
    joined = bad.join(n, "run_id", "left").fillna({"messages": 0})
    return joined.select("run_id", "messages", "errors",
                         ((F.col("messages") == 0) & (F.col("errors") > 0)).alias("ingest_failed"))


def token_usage(replies: DataFrame) -> DataFrame:
    """Token sums per run and provider."""
    return replies.groupBy("run_id", "provider").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"))
