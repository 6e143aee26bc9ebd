"""The digest as an ordered table of lines, and its assembly into one text per run.

A line is ``run_id, section, grp, item, key, line, text``; the first six columns give its place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import fixed
from postloom.functions.dates import minute_text
from postloom.functions.text import excerpt, trim_space
from postloom.operators import ranking, stats
from postloom.operators.messages import (confidence_percent, only_high_priority, priority_text,
                                         read_badge)
from postloom.params import DigestOptions
from postloom.session import stage

ORDER = ["section", "grp", "item", "key", "line"]
HEADER, HIGHLIGHTS, SUMMARY, ACCOUNTS, ATTENTION, LABELS, FOOTER = range(7)


def _place(df: DataFrame, section: int, lines: Column, grp: Column | None = None,
           item: Column | None = None, key: Column | None = None) -> DataFrame:
    """Explode an array of texts (nulls are left out) into placed lines."""
    empty = F.lit("")
    return df.select(
        "run_id", F.lit(section).alias("section"), (grp if grp is not None else empty).alias("grp"),
        (item if item is not None else F.lit(0)).cast("bigint").alias("item"),
        (key if key is not None else empty).alias("key"),
        F.posexplode(F.array_compact(lines)).alias("line", "text"))


def _head_line(df: DataFrame, section: int, *texts: str) -> DataFrame:
    """Lines that open a section, ahead of its groups."""
    return _place(df, section, F.array(*[F.lit(t) for t in texts]), item=F.lit(-1).cast("bigint"))


def _no_text() -> Column:
    return F.lit(None).cast("string")


def _if(condition: Column | bool, *texts: Column) -> list[Column]:
    if condition is True:
        return list(texts)
    if condition is False:
        return []
    return [F.when(condition, t) for t in texts]


def _number(name: str) -> Column:
    return F.col(name).cast("string")


def header_lines(runs: DataFrame, options: DigestOptions, fallback: bool = False) -> DataFrame:
    """``runs`` has ``run_id, generated_at``."""
    texts = [
        F.lit(fixed.FALLBACK_TITLE if fallback else fixed.DIGEST_TITLE), F.lit(""),
        F.concat(F.lit("**Run ID:** "), "run_id"),
        F.concat(F.lit("**Generated:** "), minute_text(F.col("generated_at"))),
        *_if(bool(options.account_label), F.lit(f"**Account:** {options.account_label}")),
        *_if(fallback, F.lit(fixed.FALLBACK_STATUS), F.lit(""), F.lit("---")),
    ]
    return _place(runs, HEADER, F.array(*texts))


def highlight_lines(runs: DataFrame, highlights: DataFrame) -> DataFrame:
    """The highlight section of every run; a neutral line when there is nothing to tell."""
    head = _head_line(runs, HIGHLIGHTS, "## Highlights")
    told = _place(highlights, HIGHLIGHTS, F.array(F.concat(F.lit("- "), "text")),
                  grp=F.col("kind").cast("string"), item=F.col("weight"), key=F.col("key"))
    quiet = runs.join(highlights.select("run_id").distinct(), "run_id", "left_anti")
    neutral = _place(quiet, HIGHLIGHTS, F.array(F.lit(fixed.NOTHING_NOTABLE)))
    return head.unionByName(told).unionByName(neutral)


def _top_texts(title: str, column: str) -> Column:
    shown = F.transform(F.col(column), lambda s: F.concat(F.lit("- "), s))
    empty = F.array().cast("array<string>")
    return F.when(F.size(column) > 0, F.concat(F.array(F.lit(title)), shown)).otherwise(empty)


def summary_lines(totals: DataFrame, options: DigestOptions, fallback: bool = False) -> DataFrame:
    """``totals``: run counts with ``labels`` text, ``top_senders``, ``top_domains`` and
    ``total_messages``."""
    counts = F.array_compact(F.array(
        F.lit("## Summary"), F.lit(""),
        F.concat(F.lit("**Fetched:** "), _number("fetched")),
        F.concat(F.lit("**Classified:** "), _number("classified")),
        F.concat(F.lit("**Failed:** "), _number("failed")),
        F.format_string("**Accounts:** %d checked, %d succeeded, %d failed",
                        "accounts_checked", "accounts_succeeded", "accounts_failed"),
        F.concat(F.lit("**High priority:** "), _number("high_priority")),
        *_if(options.include_read_status, F.concat(F.lit("**Read:** "), _number("read")),
             F.concat(F.lit("**Unread:** "), _number("unread"))),
        F.concat(F.lit("**Labels:**"), F.coalesce("labels", F.lit("")))))
    last = F.array_compact(F.array(*([_no_text()] if fallback else [F.format_string(
        "**Messages:** %d classified (%d fetched, %d failed)",
        "total_messages", "fetched", "failed")])))
    lines = F.concat(counts, _top_texts("**Top senders:**", "top_senders"),
                     _top_texts("**Noisiest domains:**", "top_domains"), last)
    return _place(totals, SUMMARY, lines)


def account_lines(runs: DataFrame, accounts: DataFrame, options: DigestOptions,
                  fallback: bool = False) -> DataFrame:
    """``accounts``: account counts with ``labels`` text, ``top_senders`` and ``top_domains``."""
    with_rows = accounts.select("run_id").distinct()
    counts = F.array_compact(F.array(
        F.concat(F.lit("### "), _text("account_label")), F.lit(""),
        F.format_string("**Fetched:** %d | **Classified:** %d | **Failed:** %d",
                        "fetched", "classified", "failed"),
        *_if(options.include_read_status,
             F.format_string("**Read:** %d | **Unread:** %d", "read", "unread")),
        F.concat(F.lit("**Labels:**"), F.coalesce("labels", F.lit("")))))
    error = F.array_compact(F.array(F.when(F.col("error") != "", F.concat(
        F.lit("⚠️ **Fetch error:** "), "error"))))
    lines = F.concat(counts, _top_texts("**Top senders:**", "top_senders"),
                     _top_texts("**Noisiest domains:**", "top_domains"), error)
    body = _place(accounts, ACCOUNTS, lines, grp=F.col("account_label"))
    if fallback:
        return _head_line(with_rows, ACCOUNTS, "## Account Stats").unionByName(body)
    none = _place(runs.join(with_rows, "run_id", "left_anti"), ACCOUNTS,
                  F.array(F.lit("No account stats available.")))
    return _head_line(runs, ACCOUNTS, "## Account Stats").unionByName(body).unionByName(none)


def _text(c: Column | str) -> Column:
    """A text, empty where null: a missing field leaves its line."""
    return F.coalesce(c, F.lit(""))


def _entry_head(options: DigestOptions) -> list[Column]:
    return [
        F.concat(F.lit("### "), _number("item"), F.lit(". "), _text("subject")), F.lit(""),
        F.concat(F.lit("**From:** "), _text("from_addr"), F.lit(" | **Date:** "),
                 F.coalesce(minute_text(F.col("date")), F.lit(fixed.NO_TIME))),
        *_if(options.include_read_status,
             F.concat(F.lit("**Status:** "), read_badge(F.col("is_read")))),
    ]


def _priority_line() -> Column:
    return F.concat(F.lit("**Priority:** "), priority_text(F.coalesce("priority", F.lit(""))))


def _reason_line() -> Column:
    return F.concat(F.lit("**Reason:** "), _text("reason"))


def attention_lines(rows: DataFrame, options: DigestOptions) -> DataFrame:
    """High-priority entries of the digest's rows."""
    high = ranking.number_entries(only_high_priority(rows), ["run_id"])
    runs = high.select("run_id").distinct()
    lines = F.array(*_entry_head(options), _priority_line(), _reason_line())
    close = _place(runs, ATTENTION, F.array(F.lit("---")), grp=F.lit("~"))
    return (_head_line(runs, ATTENTION, fixed.NEEDS_ATTENTION)
            .unionByName(_place(high, ATTENTION, lines, item=F.col("item")))
            .unionByName(close))


def _list_lines(title: Sequence[str], items: Column) -> Column:
    return F.concat(F.array(*[F.lit(t) for t in title]),
                    F.transform(items, lambda s: F.concat(F.lit("- "), _text(s))))


def _analysis_lines(options: DigestOptions) -> Column:
    """What follows the reason: the analysis, or why there is none."""
    empty = F.array().cast("array<string>")
    if not options.include_summaries:
        return empty
    strings = F.array().cast("array<string>")
    points = ranking.head_items(F.coalesce("key_points", strings),
                                options.max_key_points_per_message)
    actions = ranking.head_items(F.coalesce("action_items", strings),
                                 options.max_action_items_per_message)
    parts = [F.array(F.concat(F.lit("**Summary:** "), "summary"))]
    if options.include_key_points:
        parts.append(_list_lines(["", "**Key points:**"], points))
    if options.include_action_items:
        parts.append(F.when(F.size("action_items") > 0,
                            _list_lines(["", "**Action items:**"], actions)).otherwise(empty))
    raw = F.concat(F.lit("> "), excerpt(F.coalesce("excerpt", F.lit("")), options.max_message_excerpt))
    after_error = raw if options.include_raw_excerpt_fallback else F.lit(fixed.OMITTED_AFTER_ERROR)
    no_summary = raw if options.include_raw_excerpt_fallback else F.lit(fixed.OMITTED_NO_SUMMARY)
    failed = F.concat(F.lit("⚠️ **Analysis failed ("), _text("stage"), F.lit("):** "), _text("error"))
    has_summary = trim_space(F.coalesce("summary", F.lit(""))) != ""
    return (F.when(has_summary, F.concat(*parts))
            .when(F.col("error").isNotNull(), F.array(failed, after_error))
            .otherwise(F.array(no_summary)))


def label_lines(rows: DataFrame, options: DigestOptions) -> DataFrame:
    """One section per label, entries numbered by importance."""
    numbered = ranking.number_entries(rows, ["run_id", "label"])
    sizes = rows.groupBy("run_id", "label").agg(F.count(F.lit(1)).alias("n"))
    head = _place(sizes, LABELS, F.array(F.lit(""), F.concat(
        F.lit("## "), _text("label"), F.lit(" ("), _number("n"), F.lit(")"))),
                  grp=F.col("label"))
    entry = F.concat(
        F.array(*_entry_head(options), _priority_line(),
                F.concat(F.lit("**Confidence:** "),
                         confidence_percent(F.coalesce("confidence", F.lit(0.0)))),
                _reason_line()),
        _analysis_lines(options))
    return head.unionByName(
        _place(numbered, LABELS, entry, grp=F.col("label"), item=F.col("item")))


def footer_lines(runs: DataFrame, options: DigestOptions, fallback: bool = False) -> DataFrame:
    mode = " (fallback mode)" if fallback else ""
    return _place(runs, FOOTER, F.array(*[F.lit(t) for t in (
        "", "---", "", f"*Generated by {options.generator}{mode}*", "")]))


def capped_entries(entries: DataFrame, options: DigestOptions, fallback: bool = False) -> DataFrame:
    """The entries a digest shows: priority filter, then the cap."""
    rows = only_high_priority(entries) if options.priority_only else entries
    if fallback:
        return ranking.first_fetched(rows, options.max_messages)
    return ranking.most_important(rows, options.max_messages)


def _shown(entries: DataFrame, options: DigestOptions, fallback: bool = False) -> DataFrame:
    """The capped entries, stored: sections read them more than once, and where a cap holds they are few."""
    rows = capped_entries(entries, options, fallback)
    return stage(rows, "shown") if options.max_messages > 0 else rows


def with_lists(counts: DataFrame, group: list[str], labels: DataFrame, senders: DataFrame,
               domains: DataFrame) -> DataFrame:
    """Counts with label text and top lists of the same group."""
    return (
        counts.join(stats.label_text(labels, group), group, "left")
        .join(stats.top_lists(senders, group, "sender", "top_senders"), group, "left")
        .join(stats.top_lists(domains, group, "domain", "top_domains"), group, "left")
    )


def markdown_lines(runs: DataFrame, totals: DataFrame, accounts: DataFrame, entries: DataFrame,
                   highlights: DataFrame, options: DigestOptions = DigestOptions()) -> DataFrame:
    """All lines of the main digest."""
    rows = _shown(entries, options)
    shown = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_messages"))
    parts = [header_lines(runs, options), highlight_lines(runs, highlights)]
    if options.include_global_stats:
        parts.append(summary_lines(totals.join(shown, "run_id", "left").fillna(
            {"total_messages": 0}), options))
    if options.include_account_stats:
        parts.append(account_lines(runs, accounts, options))
    parts += [attention_lines(rows, options), label_lines(rows, options),
              footer_lines(runs, options)]
    return _union(parts)


def fallback_lines(runs: DataFrame, totals: DataFrame, accounts: DataFrame, entries: DataFrame,
                   options: DigestOptions = DigestOptions()) -> DataFrame:
    """All lines of the digest for runs whose classification failed: a flat message list."""
    rows = _shown(entries, options, fallback=True)
    numbered = ranking.number_fetch_order(rows, ["run_id"])
    parts = [header_lines(runs, options, fallback=True)]
    if options.include_global_stats or options.include_account_stats:
        parts += [summary_lines(totals, options, fallback=True),
                  account_lines(runs, accounts, options, fallback=True)]
    else:
        parts.append(_head_line(runs, SUMMARY, "No stats available."))
    size = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    sized = runs.join(size, "run_id", "left").fillna({"n": 0})
    head = _place(sized, LABELS, F.array(F.lit(""), F.lit("---"), F.lit(""), F.format_string(
        "## Fetched Messages (%d)", "n")), item=F.lit(-1).cast("bigint"))
    lines = F.array(*_entry_head(options), F.lit(""), F.concat(
        F.lit("> "), excerpt(F.coalesce("excerpt", F.lit("")), options.max_message_excerpt)))
    parts += [head, _place(numbered, LABELS, lines, item=F.col("item")),
              footer_lines(runs, options, fallback=True)]
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Half of what a text in a row can hold.
MOST_BYTES = 1 << 30


def sizes(lines: DataFrame) -> DataFrame:
    """``run_id, bytes`` of the digests that the lines make up."""
    size = F.sum(F.octet_length("text") + 1) - 1
    return lines.groupBy("run_id").agg(size.alias("bytes"))


def assemble(lines: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``run_id, bytes, payload, payload_hash`` per run: the whole digest as one text.

    A digest of more than ``most_bytes``, measured before any text is put together, has neither payload nor hash: no row
    holds it, and its lines, in the line table and its range-partitioned files, are the product. What
    ``max_messages`` does not bound, such as the lines of a run's accounts, never meets in one row beyond that.
    """
    measured = stage(sizes(lines), "sizes")
    fits = measured.where(F.col("bytes") <= most_bytes)
    ordered = F.sort_array(F.collect_list(F.struct(*ORDER, "text")))
    texts = lines.join(fits.select("run_id"), "run_id", "left_semi").groupBy("run_id").agg(F.array_join(
        F.transform(ordered, lambda r: r["text"]), "\n").alias("payload"))
    return measured.join(texts, "run_id", "left").withColumn("payload_hash", F.sha2("payload", 256))
