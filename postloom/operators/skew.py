"""Helpers that keep hot groups from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.session import stage


def uid_block(uid: Column, bits: int) -> Column:
    """Block number of a uid; a block holds at most ``2**bits`` uids of one account and folder."""
    return F.shiftright(uid, bits)


def split_row_number(df: DataFrame, group: Sequence[str],
                     levels: Sequence[Sequence[tuple[Column, bool]]],
                     order: Sequence[Column], name: str) -> DataFrame:
    """Exact 1-based row numbers inside groups of any size, without one task per group.

    ``levels`` lists prefixes of the order, coarse to fine, as ``(expression, ascending)``. Rows are
    numbered inside the finest block only; the blocks before it add their counts, level by level.
    A window over a group therefore sees one row per block, not one row per record, and the rows
    themselves are read twice: once to count the blocks, once to be numbered.
    """
    out = df
    names: list[list[str]] = []
    for depth, level in enumerate(levels):
        names.append([f"_l{depth}_{i}" for i in range(len(level))])
        out = out.withColumns(dict(zip(names[-1], [expr for expr, _ in level])))
    block = [*group, *[n for level in names for n in level]]
    blocks = out.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"))
    parent = list(group)
    starts = blocks
    for depth, level in enumerate(levels):
        before = (
            Window.partitionBy(*parent)
            .orderBy(*[F.col(n).asc() if asc else F.col(n).desc()
                       for n, (_, asc) in zip(names[depth], level)])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        parent = parent + names[depth]
        counts = blocks.groupBy(*parent).agg(F.sum("_n").alias("_s"))
        offset = counts.withColumn("_at", F.coalesce(F.sum("_s").over(before), F.lit(0)))
        # a struct as the key: null equals null in its fields, so no group is lost
        key = F.struct(*parent)
        starts = starts.withColumn("_key", key).join(
            offset.select(key.alias("_key"), F.col("_at").alias(f"_o{depth}")), "_key").drop("_key")
    total = sum((F.col(f"_o{depth}") for depth in range(len(levels))), F.lit(0))
    out = out.withColumn("_key", F.struct(*block)).join(
        starts.select(F.struct(*block).alias("_key"), total.cast("bigint").alias("_start")), "_key")
    inside = F.row_number().over(Window.partitionBy(*block).orderBy(*order)).cast("bigint")
    return out.withColumn(name, F.col("_start") + inside).drop("_start", "_key", *block[len(group):])


def ranged_row_number(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Exact 1-based row numbers inside groups of any size, by one exchange of the rows.

    Rows are dealt by ranges of (group, order), so a hot group spreads over tasks, sorted there and stored with their
    place. What a partition holds of a group is one small row; the counts of the partitions before give where its
    numbers begin. The stored rows fix the places: nothing is numbered twice in two ways when a task is lost. ``order``
    should name a row of a group: rows equal in all of it meet in one task.
    """
    by = [*[F.col(g).asc() for g in group], *order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns(
        {"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    rows = stage(placed, "numbered")
    key = F.struct("_part", *group)  # a struct as the key: null equals null in its fields, so no group is lost
    parts = rows.groupBy("_part", *group).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1
    shifts = stage(parts.select(key.alias("_key"), shift.alias("_shift")), "shifts")
    return rows.withColumn("_key", key).join(shifts, "_key").withColumn(
        name, F.col("_place") + F.col("_shift")).drop("_key", "_shift", "_part", "_place")
