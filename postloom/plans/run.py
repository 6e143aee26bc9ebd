"""One scheduled run from end to end, with the user's own source, classifier and renderer."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom import fixed
from postloom.functions.dates import fetch_since
from postloom.operators import digest, messages, prompts, ranking, replies
from postloom.params import TriageOptions
from postloom.plans import triage as plan
from postloom.session import TEXT_CODEC, stage, staging
from postloom.sources.answers import Calls, ReplyLedger
from postloom.sources.ledger import Ledger

# since -> (messages, account_status), both without run_id
Ingest = Callable[[dt.datetime], tuple[DataFrame, DataFrame]]


def window_start(ledger: Ledger, now: dt.datetime, window_hours: float | None = None,
                 max_window_hours: float = fixed.MAX_WINDOW_HOURS) -> dt.datetime:
    """Where the fetch starts: the last completed run, within the look-back cap."""
    at = F.lit(now).cast("timestamp_ntz")
    last = ranking.last_completed(ledger.runs())
    return last.select(fetch_since(
        at, F.col("finished_at"), window_hours, max_window_hours)).first()[0]


def classify_all(fresh: DataFrame, provider: Callable[[str], str], options: TriageOptions,
                 template: str | None = None, parallelism: int | None = None, calls: Calls = Calls(),
                 answered: ReplyLedger | None = None, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Prompt batches of the messages, and the classifier's replies with one repair each.

    With ``texts`` messages hold references to their bodies, see ``build_prompts``; prompts are then dealt as references.

    Replies are stored before later steps read them. With ``answered`` each is stored as it comes, so a lost task
    repeats no call that was answered; without, it repeats those of its partition.
    """
    batched = stage(prompts.request_batches(fresh), "requests")
    made = prompts.build_prompts(batched, options.labels, template, options.system_prompt, texts, parallelism)
    first = stage(prompts.classify(
        made, provider, parallelism=parallelism if texts is None or answered is not None else None, calls=calls,
        replies=answered), "answers")
    requests = batched.select("run_id", "batch_id", "account_label", "uid")
    if options.repair_attempts == 0:
        return requests, first
    # a filter on what is parsed would be pushed below the parse, with the parse in it again for each use of a column
    parsed = stage(replies.parse_replies(first.where(F.col("reply_error").isNull()), options.labels).select(
        *replies.BATCH, "raw", "parse_error"), "first")
    again = stage(prompts.classify(replies.repair_prompts(parsed, options.labels), provider, 1,
                                   parallelism, calls, answered), "repairs")
    return requests, first.unionByName(again)


def run_once(spark: SparkSession, ledger: Ledger, ingest: Ingest, provider: Callable[[str], str],
             payload_path: str, options: TriageOptions = TriageOptions(),
             now: dt.datetime | None = None, window_hours: float | None = None,
             template: str | None = None, renderer: plan.Renderer = digest.markdown_lines,
             parallelism: int | None = None, calls: Calls = Calls(),
             answered: ReplyLedger | None = None) -> plan.TriageResult:
    """Open a run, fetch, skip what is known, classify, render, and record.

    The tables stored on the way are in one folder; ``release()`` of the result removes it.
    """
    with staging() as staged:
        result = _run_once(spark, ledger, ingest, provider, payload_path, options, now, window_hours, template,
                           renderer, parallelism, calls, answered)
        result.staged = staged
        return result


def _run_once(spark: SparkSession, ledger: Ledger, ingest: Ingest, provider: Callable[[str], str],
              payload_path: str, options: TriageOptions, now: dt.datetime | None, window_hours: float | None,
              template: str | None, renderer: plan.Renderer, parallelism: int | None, calls: Calls,
              answered: ReplyLedger | None) -> plan.TriageResult:
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    at = F.lit(now).cast("timestamp_ntz")
    since = window_start(ledger, now, window_hours, options.max_window_hours)
    opened = stage(spark.range(1).select(F.uuid().alias("id"), at.alias("started_at"),
                                         F.lit("").alias("status")), "opened")
    if not options.dry_run:
        ledger.record_runs(opened, at)
    run_id = F.lit(opened.first().id)
    # the source is read once: every later step sees the same rows
    landed, status = (df.withColumn("run_id", run_id) for df in ingest(since))
    fetched = stage(messages.search_window(landed, F.lit(since).cast("timestamp_ntz")).withColumns(
        {"body_ref": F.monotonically_increasing_id()}), "landed", TEXT_CODEC)
    # bodies stay where they are stored until prompts are put together
    refs, texts = fetched.drop("body"), fetched.select(*messages.RUN_KEY, "body_ref", "body")
    fetched = fetched.drop("body_ref")
    status = stage(status, "status")
    # the ledger is long, the fetch short: only files that may hold a fetched key are read
    known = stage(ledger.lookup("processed_messages", fetched), "known")
    _, fresh = plan.select_messages(refs, status, known, options)
    requests, answers = classify_all(fresh, provider, options, template, parallelism, calls, answered, texts)
    runs = ledger.runs().select("id", "finished_at", "status")
    if options.dry_run:
        runs = runs.unionByName(opened.select(
            "id", F.lit(None).cast("timestamp_ntz").alias("finished_at"), F.lit("running").alias("status")))
    this_run = runs.where(F.col("id") == run_id)
    result = plan.triage(
        fetched, requests, answers, status, this_run, known, ledger.snapshot_headers(),
        ledger.snapshot_counts("label"), ledger.snapshot_counts("sender"), options, at, renderer,
        history=runs)
    plan.record(result, ledger, payload_path, at, options)
    return result
