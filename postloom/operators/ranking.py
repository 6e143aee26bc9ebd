"""Ordering, capping and numbering of digest entries and fetch batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom import fixed
from postloom.operators.messages import priority_rank
from postloom.operators.skew import ranged_row_number, split_row_number, uid_block
from postloom.session import stage

UID_BLOCK_BITS = 16
# Rows that carry this column, unique among them, are ranked without their texts.
ENTRY_ID = "entry_id"


def _importance() -> list[Column]:
    return [priority_rank(F.col("priority")).asc(), F.desc("date"), F.asc("account_label"),
            F.asc("uid")]


def most_important(rows: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most important entries per run: priority first, then date; 0 keeps all."""
    if limit <= 0:
        return rows
    return _first(rows, limit, _importance())


def first_fetched(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` entries per run in fetch order, unsorted by importance; 0 keeps all."""
    if limit <= 0:
        return rows
    return _first(rows, limit, [F.asc("account_label"), F.asc("uid")])


def _first(rows: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """The first ``limit`` rows per run. With an ``ENTRY_ID`` only ids and the order's columns are sorted and moved; the
    ids that stay are stored, so that Spark knows how few they are and brings them to the rows."""
    w = Window.partitionBy("run_id").orderBy(*order)
    narrow = ENTRY_ID in rows.columns
    ranked = rows.select("run_id", "account_label", "uid", "date", "priority", ENTRY_ID) if narrow else rows
    kept = ranked.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= limit).drop("_rank")
    return rows.join(stage(kept.select(ENTRY_ID), "first"), ENTRY_ID, "left_semi") if narrow else kept


def number_entries(rows: DataFrame, group: Sequence[str], name: str = "item") -> DataFrame:
    """1-based position of an entry in its section, most important first; groups of any size."""
    return ranged_row_number(rows, group, _importance(), name)


def number_fetch_order(rows: DataFrame, group: Sequence[str], name: str = "item") -> DataFrame:
    """1-based position by ``(account, uid)`` inside groups of any size."""
    return ranged_row_number(rows, group, [F.asc("account_label"), F.asc("uid")], name)


def fetch_batches(messages: DataFrame, size: int = fixed.FETCH_BATCH,
                  group: Sequence[str] = ("account_label", "folder")) -> DataFrame:
    """Consecutive batches of at most ``size`` uids per group; one batch when not positive."""
    if size <= 0:
        return messages.withColumn("batch", F.lit(0).cast("bigint"))
    levels = [[(uid_block(F.col("uid"), UID_BLOCK_BITS), True)]]
    numbered = split_row_number(messages, group, levels, [F.asc("uid")], "_pos")
    return numbered.withColumn("batch", F.floor((F.col("_pos") - 1) / size)).drop("_pos")


def group_by_account(messages: DataFrame, columns: Sequence[str], bits: int = 12) -> DataFrame:
    """Messages of an account as lists in uid order, one list per block of ``2**bits`` uids.

    The folder is part of a row, not of the key; a uid repeats at most once per folder.
    """
    rows = F.sort_array(F.collect_list(F.struct("uid", *[c for c in columns if c != "uid"])))
    return messages.groupBy("account_label", uid_block(F.col("uid"), bits).alias("block")).agg(
        rows.alias("messages"))


def head_items(items: Column, limit: int) -> Column:
    """First ``limit`` list items; all when not positive."""
    return F.slice(items, 1, limit) if limit > 0 else items


def list_runs(runs: DataFrame, limit: int = fixed.LIST_RUNS_LIMIT) -> DataFrame:
    """Latest runs by start; ten when the limit is not positive."""
    return runs.orderBy(F.desc("started_at"), F.asc("id")).limit(
        limit if limit > 0 else fixed.LIST_RUNS_LIMIT)


def last_completed(runs: DataFrame) -> DataFrame:
    """Finish time of the latest completed run, one row."""
    return runs.where(F.col("status") == "completed").agg(F.max("finished_at").alias("finished_at"))
