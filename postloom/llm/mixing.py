"""Mixing sources to target weights by Pfair scheduling.

A source is an endless stream of its documents in hashed order, cut into blocks. Block ``k`` of a
source with share ``a / period`` is released at slot ``floor(k * period / a)`` and due by
``ceil((k + 1) * period / a)``; earliest deadline first gives every released block its slot in time, so
a source is never a whole block away from its share.

The mixture is as long as the targets ask: until the source that is largest beside its target was used up once. This
length is cut into equal frames of at most ``PERIOD`` slots; a frame gives each source whole slots, one is scheduled,
and every block finds its slot there. No document is lost: a source has slots for all of it. Sources of higher target
than their size start over (``copy`` counts). A target under one slot a frame is met with one slot. Null is a
source of its own; repeated rows are documents of their own; rows with a null doc_id are ordered by text.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import packed, unpacked

BLOCK = 32
PERIOD = 1 << 16
# Sources have slots each in a plan that is made in the driver and sent to every task: so many at most, else an error.
SOURCES = 1 << 14
EXPONENT = 0.8
NUMBERING = 4096


def frame(weights: Mapping[str, float], sizes: Mapping[str, int], block: int = BLOCK,
          longest: int = PERIOD) -> tuple[dict[str, int], int]:
    """Whole slots of each source in a frame, and the number of frames.

    The frames are as long as all sources need to be used up once at their targets: size / share of the one
    that needs longest. A source has at least the slots that its blocks need, so a frame may be longer than the targets
    ask by less than a slot a source.
    """
    named = sorted(k for k, w in weights.items() if w > 0 and sizes[k] > 0)
    if not named:
        return {}, 0
    total = sum(Fraction(weights[k]) for k in named)
    share = {k: Fraction(weights[k]) / total for k in named}
    length = max(math.ceil(Fraction(sizes[k], block) / share[k]) for k in named)
    frames = -(-length // longest)
    slots = -(-length // frames)
    out = {k: max(int(share[k] * slots), -(-(-(-sizes[k] // block)) // frames)) for k in named}
    spare = max(0, slots - sum(out.values()))
    for k in sorted(named, key=lambda k: (out[k] - share[k] * slots, k))[:spare]:
        out[k] += 1
    return out, frames


def pfair(slots: Mapping[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, slot) for one period, earliest deadline first among the released blocks."""
    period = sum(slots.values())
    released: dict[int, list[str]] = {0: sorted(slots)}
    done = dict.fromkeys(slots, 0)
    ready: list[tuple[int, str]] = []
    plan = []
    for slot in range(period):
        for source in released.pop(slot, ()):
            heapq.heappush(ready, (-(-(done[source] + 1) * period // slots[source]), source))
        _, source = heapq.heappop(ready)
        plan.append((source, done[source], slot))
        done[source] += 1
        if done[source] < slots[source]:
            start = done[source] * period // slots[source]
            if start > slot:
                released.setdefault(start, []).append(source)
            else:
                heapq.heappush(ready, (-(-(done[source] + 1) * period // slots[source]), source))
    return plan


def tempered(sizes: Mapping[str, int], exponent: float = EXPONENT) -> dict[str, float]:
    """Targets that flatten the sizes: size to the power ``exponent``."""
    return {k: float(n) ** exponent for k, n in sizes.items()}


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``_index``, 0-based in each ``_source`` by hashed id.

    A hot source is numbered in many buckets of the hash; buckets before add their counts.
    """
    rows = rows.withColumn("_hash", F.xxhash64("doc_id")).withColumn(
        "_bucket", F.pmod("_hash", F.lit(NUMBERING)).cast("int"))
    counts = rows.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_source", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_hash", "doc_id", *order)
    return rows.withColumn("_in", F.row_number().over(inside)).join(starts, ["_source", "_bucket"]).withColumn(
        "_index", F.col("_start") + F.col("_in") - 1)


def schedule(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK,
             exponent: float = EXPONENT) -> DataFrame:
    """``packed`` rows with copy, block, slot and position in the mixture.

    ``weights`` maps source names to targets (null as None); without it sizes to the power ``exponent``
    are the targets. A source without a positive weight is not part of the mixture.
    """
    spark = docs.sparkSession
    rows = packed(docs).withColumn("_name", F.col("_row.source").cast("string"))
    rows = rows.withColumn("_source", F.concat(F.lit("="), "_name")).fillna("", ["_source"])
    sizes = {r[0]: r[1] for r in rows.groupBy("_source").count().collect()}
    if weights is None:
        weights = tempered(sizes, exponent)
    else:
        named = {"" if k is None else f"={k}": w for k, w in weights.items()}
        weights = {k: named.get(k, 0.0) for k in sizes}
    if len(sizes) > SOURCES:
        raise ValueError(f"{len(sizes)} sources; join small ones to at most {SOURCES}")
    slots, frames = frame(weights, sizes, block)
    period = sum(slots.values())
    table = spark.createDataFrame(pfair(slots), "_source string, _k bigint, _slot bigint")
    per_source = spark.createDataFrame(
        [(s, a, sizes[s], -(-frames * a * block // sizes[s]) - 1) for s, a in slots.items()],
        "_source string, _a bigint, _size bigint, _copies bigint")
    # Both tables are bounded: by PERIOD slots and one more a source, and by the sources.
    placed = _numbered(rows, ["text"]).join(F.broadcast(per_source), "_source")
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies"))))
    placed = placed.withColumn("_at", F.col("_index") + F.col("copy") * F.col("_size"))
    placed = placed.withColumn("block", F.floor(F.col("_at") / block)).withColumn(
        "_k", F.col("block") % F.col("_a")).drop("_size")
    slot = F.floor(F.col("block") / F.col("_a")) * period + F.col("_slot")
    placed = placed.where(F.col("block") < F.lit(frames) * F.col("_a")).join(
        F.broadcast(table), ["_source", "_k"]).withColumn("slot", slot)
    return placed.withColumn("position", F.col("slot") * block + F.col("_at") % block)


def mixture(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """One row per use of a document: doc_id, source, copy, block, slot, position."""
    narrow = docs.select("doc_id", F.xxhash64("text").alias("text"), "source")
    return schedule(narrow, weights, block).select(
        "doc_id", F.col("_name").alias("source"), "copy", "block", "slot", "position")


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """The documents of the mixture in its order: partitions are ranges of positions, sorted."""
    rows = schedule(docs, weights, block).select("position", "_row")
    return unpacked(rows.repartitionByRange("position").sortWithinPartitions("position"))
