"""Texts that rows refer to by an id, brought to the rows.

A join of many rows with few long texts makes a copy of a text for each row, and any exchange behind it moves the copies.
Here rows stay narrow through joins and numbering. In the end neighbours form blocks of a bounded number of rows, a text
goes once to each block that refers to it, and is copied to the rows there, behind the last exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.session import stage

KEY = ["account_label", "uid"]
RUN_KEY = ["run_id", *KEY]
PLACE = "_place"
BLOCK_BITS = 8
# (name of the texts, id, number among the texts of that id) -> text
Find = Callable[[str, Column, Column], Column]


def numbered_refs(rows: DataFrame, texts: DataFrame, ref: str, nth: str, how: str = "inner") -> DataFrame:
    """``rows`` once for each text of their ``ref``, which ``nth`` numbers; a ``left`` join keeps rows without a text."""
    known = texts.groupBy(ref).agg(F.count(F.lit(1)).alias("_n"))
    times = F.sequence(F.lit(1).cast("bigint"), F.coalesce("_n", F.lit(1).cast("bigint")))
    return rows.join(known, ref, how).withColumn(nth, F.explode(times)).drop("_n")


def join_texts(rows: DataFrame, refs: DataFrame, texts: DataFrame, how: str = "left") -> DataFrame:
    """``rows`` with the text their message refers to, where one use of it follows and no exchange.

    ``refs`` is ``account_label, uid, body_ref``; ``texts`` is ``body_ref`` and a text. The rows go to the texts, narrow;
    those without a reference go by their key, so that they spread.
    """
    return at_texts(rows.join(refs, KEY, how), texts, how)


def at_texts(named: DataFrame, texts: DataFrame, how: str = "left") -> DataFrame:
    """``named`` with its reference replaced by the text: once for each text of the reference."""
    ref, text = texts.columns
    there = texts.select(F.col(ref).alias("_there"), text)
    known = named.withColumn("_at", F.coalesce(ref, F.xxhash64(*KEY)))
    return known.join(there, (F.col("_at") == F.col("_there")) & F.col(ref).isNotNull(), how).drop("_at", "_there", ref)


def with_own_texts(groups: DataFrame, rows: str, texts: DataFrame, partitions: int) -> DataFrame:
    """The rows of ``groups`` with the text of their message, where each message has a text of its own.

    A group has its rows in the list ``rows``; its messages follow one another in (run, account, uid). ``texts`` is
    ``run_id, account_label, uid, body_ref`` and a text. Groups are dealt by ranges of their first message and stored with
    their place, so that a text is sent to the place of its message by the bounds of the ranges, and moved once. Where a
    key is the bound of a place, messages of that key may also be at the end of the place before, and their texts go to
    both. Columns of the result are ``_place``, those of the groups, those of the rows, and the text. It comes in
    ``partitions`` partitions by ``_place``: grouping by the place and more needs no exchange.
    """
    names = [c for c in groups.columns if c != rows]
    first = groups.withColumn("_first", F.array_min(F.transform(rows, lambda r: F.struct(*[
        (F.col("run_id") if c == "run_id" else r[c]).alias(c) for c in RUN_KEY]))))
    placed = stage(first.repartitionByRange(partitions, "_first").withColumn(PLACE, F.spark_partition_id()), "places")
    starts = placed.groupBy(PLACE).agg(F.min("_first").alias("_first")).orderBy(PLACE).collect()  # one a partition
    held = placed.select(PLACE, F.explode(F.transform(rows, lambda r: F.struct(*names, r.alias("_row")))).alias("_own"))
    ref, text = texts.columns[-2:]
    named = held.select(PLACE, F.col(f"_own._row.{ref}").alias(ref), "_own", F.lit(None).cast("string").alias(text))
    sent = texts.select(F.explode(_places(starts, texts)).alias(PLACE), ref, F.lit(None).cast(held.schema["_own"].dataType).alias(
        "_own"), text)
    both = named.unionByName(sent).repartition(partitions, PLACE).groupBy(PLACE, ref).agg(
        F.collect_list("_own").alias("_owns"), F.max(text).alias(text))
    own = both.select(PLACE, F.explode("_owns").alias("_own"), text)
    return own.select(PLACE, *[f"_own.{c}" for c in names], "_own._row.*", text).drop(ref)


def _places(starts: list, texts: DataFrame) -> Column:
    """The places where a message may be, from the first key of each place, by bisection."""
    if not starts:
        return F.array().cast("array<int>")
    key = F.struct(*RUN_KEY)
    types = {c: texts.schema[c].dataType for c in RUN_KEY}
    bounds = F.array(*[F.struct(*[F.lit(r["_first"][c]).cast(types[c]).alias(c) for c in RUN_KEY]) for r in starts])
    numbers = F.array(*[F.lit(r[PLACE]) for r in starts])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(starts).bit_length()))])
    # how many places begin at the key or before
    count = F.aggregate(steps, F.lit(0), lambda n, step: F.when(
        F.get(bounds, n + step - 1) <= key, n + step).otherwise(n))

    def held(n: Column) -> Column:
        """The place of the last of ``n`` bounds, and the one before where that bound is the key; none before the first."""
        several = F.when((n > 1) & (F.get(bounds, n - 1) == key), F.lit(2)).otherwise(F.least(n, F.lit(1)))
        return F.slice(numbers, F.greatest(n - several + 1, F.lit(1)), several)

    return F.flatten(F.transform(F.array(count), held))


def with_texts(rows: DataFrame, order: list[Column], texts: dict[str, tuple[Column, DataFrame]],
               make: Callable[[Column, Find], Column], bits: int = BLOCK_BITS, partitions: int | None = None,
               ranged: bool = False) -> DataFrame:
    """The struct that ``make`` builds of each row, as columns.

    ``texts`` has by name an array of the ids a row refers to, and a table of two columns, the id and the text. Rows that
    refer to the same texts should stand together in ``order``: a text is moved once for each block of ``2**bits`` rows
    that needs it. The blocks are stored, so both sides of the join see the same ones. Rows come in ``partitions``
    partitions if that is given; ``ranged`` deals the blocks in their order, so that a partition has neighbours.
    """
    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(partitions, "_block") if partitions else df

    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_block", F.shiftright(F.monotonically_increasing_id(), bits))
    blocks = stage(placed, "blocks")
    whole = dealt(blocks).groupBy("_block").agg(F.collect_list(F.struct(*rows.columns)).alias("_rows"))
    for name, (refs, table) in texts.items():
        ref, text = table.columns
        wanted = blocks.select("_block", F.explode(refs).alias("_ref")).where(F.col("_ref").isNotNull()).distinct()
        found = wanted.join(table.select(F.col(ref).alias("_ref"), F.col(text).alias("_text")), "_ref")
        whole = whole.join(dealt(found).groupBy("_block").agg(
            F.sort_array(F.collect_list(F.struct("_ref", "_text"))).alias(name),
            F.sort_array(F.collect_list("_ref")).alias(f"{name}_ids")), "_block", "left")

    def find(name: str, ref: Column, nth: Column) -> Column:
        # both lists are sorted by id; where it is missing, the place before the first has nothing
        return F.get(F.col(name), (F.array_position(f"{name}_ids", ref) + nth - 2).cast("int"))["_text"]

    if ranged:
        whole = whole.repartitionByRange("_block").sortWithinPartitions("_block")
    return whole.select(F.inline(F.transform("_rows", lambda r: make(r, find))))
