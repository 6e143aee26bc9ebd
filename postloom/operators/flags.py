"""Keyword flags derived from classifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import fixed
from postloom.operators.messages import label_set
from postloom.operators.skew import uid_block

FLAG_BLOCK_BITS = 12


def flag_plan(valid: DataFrame, custom: Sequence[str] = ()) -> DataFrame:
    """One keyword per classified message; labels outside the set (so ``Unknown``) give none."""
    return valid.where(F.col("label").isin(label_set(custom))).select(
        "account_label", "uid", F.col("label").alias("keyword"))


def keyword_allowed(permanent: Column, keyword: Column) -> Column:
    """Whether a server that advertises ``permanent`` flags stores the keyword."""
    return (
        keyword.startswith("\\")
        | (F.size(permanent) == 0)
        | F.array_contains(permanent, fixed.ANY_KEYWORD_FLAG)
        | F.exists(permanent, lambda f: F.lower(f) == F.lower(keyword))
    )


def for_known_accounts(flags: DataFrame, accounts: DataFrame) -> DataFrame:
    """Flags of configured accounts, with the account columns; others are skipped."""
    return flags.join(accounts, ["account_label"], "inner")


def flag_batches(flags: DataFrame) -> DataFrame:
    """The batch plan: uid lists per account and keyword.

    A list covers one block of uids, so no list grows with the size of an account.
    """
    return (
        flags.groupBy("account_label", "keyword",
                      uid_block(F.col("uid"), FLAG_BLOCK_BITS).alias("block"))
        .agg(F.sort_array(F.collect_set("uid")).alias("uids"))
    )
