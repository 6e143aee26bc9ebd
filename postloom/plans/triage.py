"""One triage pass over any number of runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import fixed
from postloom.functions.text import excerpt
from postloom.operators import asof, digest, flags, highlights, messages, ranking, replies, stats
from postloom.operators.texts import at_texts
from postloom.params import TriageOptions
from postloom.session import TEXT_CODEC, release, stage
from postloom.sources.ledger import Ledger, write_payloads


# (runs, totals, accounts, entries, highlights, options) -> digest lines
Renderer = Callable[..., DataFrame]


def run_status(flags_per_run: DataFrame) -> DataFrame:
    """Adds ``status``.

    Precedence: nothing fetched and an account failed; nothing left to do; delivery or
    classification failed; some analyses failed; some account failed; all well.
    Input: ``errors, fetched_raw, fetched, classified, analysis_failed, classify_failed,
    delivery_failed`` per run.
    """
    status = (
        F.when((F.col("fetched_raw") == 0) & (F.col("errors") > 0), F.lit("ingest_failed"))
        .when(F.col("fetched") == 0, F.lit("completed"))
        .when(F.col("delivery_failed") | F.col("classify_failed") | (F.col("classified") == 0),
              F.lit("degraded"))
        .when(F.col("analysis_failed") > 0, F.lit("partially_classified"))
        .when(F.col("errors") > 0, F.lit("partial"))
        .otherwise(F.lit("completed")))
    return flags_per_run.withColumn("status", status)


def processed_rows(entries: DataFrame, at: Column,
                   excerpt_limit: int = fixed.EXCERPT_LIMIT) -> DataFrame:
    """Messages to record as handled: those with a valid classification."""
    limit = excerpt_limit if excerpt_limit > 0 else fixed.EXCERPT_LIMIT
    return entries.where("classified").select(
        "run_id", "account_label", "uid", "is_read", F.col("label").alias("classification"),
        excerpt(F.coalesce("excerpt", F.lit("")), limit).alias("digest_excerpt"),
        at.alias("processed_at"))


@dataclass
class TriageResult:
    """The tables of a pass; all but ``statuses``, ``digests`` and ``flag_plan`` are stored."""

    entries: DataFrame
    totals: DataFrame
    accounts: DataFrame
    senders: DataFrame
    highlights: DataFrame
    lines: DataFrame
    digests: DataFrame
    statuses: DataFrame
    flag_plan: DataFrame
    valid: DataFrame
    failed: DataFrame
    staged: str = ""

    def release(self) -> None:
        """Remove the stored tables, when the pass is recorded and its result no longer read."""
        if self.staged:
            release(self.entries.sparkSession, self.staged)


def select_messages(fetched: DataFrame, account_status: DataFrame, ledger: DataFrame,
                    options: TriageOptions) -> tuple[DataFrame, DataFrame]:
    """Rows of successful accounts, and those of them no earlier run recorded."""
    usable = messages.drop_failed_accounts(fetched, account_status)
    if options.fetch_unread_only:
        usable = messages.unread(usable)
    return usable, messages.skip_processed(usable, ledger, options.force_reprocess)


def triage(fetched: DataFrame, requests: DataFrame, answers: DataFrame, account_status: DataFrame,
           runs: DataFrame, ledger: DataFrame, header_snapshot: DataFrame,
           label_snapshot: DataFrame, sender_snapshot: DataFrame,
           options: TriageOptions = TriageOptions(), now: Column | None = None,
           renderer: Renderer = digest.markdown_lines,
           history: DataFrame | None = None, deliveries: DataFrame | None = None,
           texts: DataFrame | None = None) -> TriageResult:
    """Set-at-a-time triage of every run in ``runs``.

    ``fetched``: landed messages with ``run_id`` and their ``body``, or, with ``texts`` (``body_ref`` and the text), with a
    ``body_ref`` in its place; ``requests`` and ``answers``: the prompt batches
    and the classifier's replies (see ``operators.replies.partial_fallback``); ``history``: all runs
    that may be a predecessor, by default ``runs`` itself; ``deliveries``: a log ``run_id, ok`` of
    attempts to deliver the digests, a run without a good one among its attempts failed. The entries table is written once
    to the shared folder, because statistics, highlights, digest, flags and ledger rows all start
    from it; so are the small tables of counts that many digest lines read.
    """
    # Digest and ledger show an excerpt only. It is cut once for each text, and joined last: what is moved to select
    # messages and to find their classification are rows without it. A renderer that wants whole bodies joins them by key.
    if texts is None:
        held = stage(fetched.withColumns({
            "excerpt": excerpt(F.col("body"), options.digest.max_message_excerpt),
            "body_ref": F.monotonically_increasing_id()}).drop("body"), "fetched", TEXT_CODEC)
        short, excerpts = held.drop("excerpt"), held.select("body_ref", "excerpt")
    else:
        short = stage(fetched, "fetched")
        ref, text = texts.columns
        excerpts = texts.select(F.col(ref).alias("body_ref"), excerpt(
            F.col(text), options.digest.max_message_excerpt).alias("excerpt"))
    # stored, small tables have a size that Spark knows: it brings them to the rows where its check allows
    runs, account_status = stage(runs, "runs"), stage(account_status, "status")
    usable, fresh = select_messages(short, account_status, ledger, options)
    wanted = stage(requests.join(fresh.select(*messages.RUN_KEY), messages.RUN_KEY, "left_semi"), "wanted")
    valid, failed, batches = replies.partial_fallback(
        wanted, answers, options.labels, options.repair_attempts)
    failed = stage(failed, "failed")
    rows = stage(at_texts(stats.entries(fresh, valid, failed), excerpts).withColumn(
        ranking.ENTRY_ID, F.monotonically_increasing_id()), "entries", TEXT_CODEC)

    senders = stage(stats.sender_counts(rows), "senders")
    domains, labels = stats.domain_counts(senders), stats.label_counts(rows)
    accounts = stage(digest.with_lists(
        stats.account_stats(stats.account_counts(rows), account_status),
        ["run_id", "account_label"], labels, senders, domains), "accounts")
    run_labels = stats.run_level(labels, "label")
    run_senders = stats.run_level(senders, "sender")
    totals = stage(digest.with_lists(
        stats.run_stats(accounts, stats.unrequested_replies(valid, rows)), ["run_id"],
        run_labels, run_senders, stats.run_level(domains, "domain")), "totals")

    previous = asof.previous_runs(history if history is not None else runs, header_snapshot, now)
    notable = stage(highlights.highlights(
        totals, accounts, run_labels, run_senders, stage(previous, "previous"), header_snapshot,
        label_snapshot, sender_snapshot), "highlights")

    raw_counts = usable.groupBy("run_id").agg(F.count(F.lit(1)).alias("fetched_raw"))
    hard = batches.groupBy("run_id").agg(
        F.bool_and(F.col("call_error").isNotNull()).alias("classify_failed"))
    state = stage(
        runs.select(F.col("id").alias("run_id")).join(totals, "run_id", "left")
        .join(raw_counts, "run_id", "left").join(hard, "run_id", "left")
        .fillna({"fetched_raw": 0, "fetched": 0, "classified": 0, "analysis_failed": 0,
                 "accounts_failed": 0, "classify_failed": False})
        .withColumn("errors", F.col("accounts_failed")), "state")

    generated = F.coalesce("finished_at", now if now is not None else F.current_timestamp())
    with_messages = state.where(F.col("fetched") > 0)
    shown = stage(runs.select(F.col("id").alias("run_id"), generated.alias("generated_at")).join(
        with_messages.select("run_id", (~F.col("classify_failed") & (F.col("classified") > 0)).alias(
            "main")), "run_id"), "runs_shown")

    def part(df: DataFrame, keep: DataFrame) -> DataFrame:
        return df.join(keep.select("run_id"), "run_id", "left_semi")

    main = shown.where("main").select("run_id", "generated_at")
    plain = shown.where(~F.col("main")).select("run_id", "generated_at")
    lines = renderer(
        main, part(totals, main), part(accounts, main), part(rows, main),
        part(notable, main), options.digest,
    ).unionByName(digest.fallback_lines(
        plain, part(totals, plain), part(accounts, plain), part(rows, plain),
        options.digest))
    lines = stage(lines, "lines")
    if options.digest.max_messages > 0:
        payloads = digest.assemble(lines).drop("payload")
    else:
        payloads = digest.sizes(lines).withColumn("payload_hash", F.lit(None).cast("string"))
    payloads = stage(payloads, "payloads").withColumn("sent", F.lit(True))
    if deliveries is not None:
        outcome = deliveries.groupBy("run_id").agg(F.bool_or(F.coalesce("ok", F.lit(False))).alias("ok"))
        payloads = payloads.join(outcome, "run_id", "left").withColumn(
            "sent", F.coalesce("ok", F.col("sent"))).drop("ok")
    digests = payloads.select(
        "run_id", F.lit(options.channel).alias("channel"),
        F.when(F.col("sent"), F.lit("sent")).otherwise(F.lit("failed")).alias("status"),
        "payload_hash", "bytes")
    statuses = run_status(state.join(
        digests.select("run_id", (F.col("status") == "failed").alias("delivery_failed")),
        "run_id", "left").fillna({"delivery_failed": False}))
    return TriageResult(rows, totals, accounts, senders, notable, lines, digests, statuses,
                        flags.flag_plan(valid, options.custom_labels), valid, failed)


def record(result: TriageResult, ledger: Ledger, payload_path: str, at: Column,
           options: TriageOptions = TriageOptions()) -> list[str]:
    """Write what the options allow; returns the names of the sinks written.

    A dry run writes nothing. A stateless run delivers but records no messages and flags. Messages
    of a run whose delivery or classification failed stay unrecorded, so the next run sees them.
    """
    if options.dry_run:
        return []
    written = ["payloads", "digests"]
    write_payloads(result.lines, payload_path)
    ledger.record_digests(result.digests)
    if not options.stateless:
        good = stage(result.statuses.where(~F.col("delivery_failed") & ~F.col("classify_failed")).select("run_id"), "good")
        recorded = result.entries.join(good, ["run_id"], "left_semi")
        ledger.record_messages(processed_rows(recorded, at, options.digest.max_message_excerpt))
        plan = flags.flag_plan(result.valid.join(good, ["run_id"], "left_semi"), options.custom_labels)
        ledger.record_flags(plan.select(
            "account_label", "uid", F.col("keyword").alias("flag"), at.alias("applied_at")))
        written += ["processed_messages", "flags_applied"]
    labels = stats.run_level(stats.label_counts(result.entries), "label")
    senders = stats.run_level(result.senders, "sender")
    domains = stats.run_level(stats.domain_counts(result.senders), "domain")
    header = result.totals.select(
        "run_id", at.alias("finished_at"), "accounts_failed",
        F.col("high_priority").alias("high_priority_count"))
    ledger.save_snapshots(header, labels, senders, domains)
    ledger.finish_runs(result.statuses.select(
        F.col("run_id").alias("id"), at.alias("finished_at"), "status",
        F.col("fetched").cast("bigint").alias("message_count"),
        F.when(F.col("status") == "ingest_failed", F.format_string(
            "all %d account(s) failed to fetch messages", "errors"))
        .when(F.col("delivery_failed"), F.lit("delivery failed"))
        .otherwise(F.lit("")).alias("error")))
    return written + ["snapshots", "runs"]
