"""SimHash near-dedup by multi-index hashing.

Null text counts as empty; a text without words has fingerprint zero and links like any other. Rows
with equal doc_id are rows of their own; a null doc_id never names a component that holds another id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from postloom.llm.common import (ascii_lower, components, packed, shingles, stage, unpacked, whole,
                                 words)

WIDTH = 3
DISTANCE = 3
SEGMENTS = 2


def majority(hashes: np.ndarray, piece: int = 1 << 16) -> int:
    """Bits set in over half of the 64-bit hashes, as a signed number."""
    votes = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), piece):
        part = np.ascontiguousarray(hashes[start:start + piece], dtype="<i8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            0, dtype=np.int64)
    bits = (votes * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


@pandas_udf(LongType())
def _majorities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for hashes in batches:
        yield pd.Series([majority(h) for h in hashes], dtype="int64")


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_fp``; the shingle hashes are made by Spark, the votes counted in Arrow batches."""
    tokens = docs.withColumn("_words", words(ascii_lower(whole())))
    hashed = tokens.withColumn("_hashes", shingles("_words", WIDTH, F.xxhash64)).drop("_words")
    return hashed.withColumn("_fp", _majorities("_hashes")).drop("_hashes")


def balls(bits: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` set bits among ``bits``."""
    masks, ring = {0}, {0}
    for _ in range(radius):
        ring = {m | 1 << b for m in ring for b in range(bits)} - masks
        masks |= ring
    return sorted(masks)


def links(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of distinct fingerprints ``_fp`` that differ in at most ``distance`` bits.

    One of ``segments`` equal segments differs in at most ``distance // segments`` bits: every
    fingerprint looks that ball up in the table of each segment, and whole distances are verified.
    """
    bits = 64 // segments
    masks = balls(bits, distance // segments)
    value = [F.shiftrightunsigned("_fp", s * bits).bitwiseAND(F.lit((1 << bits) - 1))
             for s in range(segments)]
    cut = prints.select("_fp", F.posexplode(F.array(*value)).alias("s", "segment"))
    table = cut.select(F.col("_fp").alias("b"), "s", "segment")
    probe = cut.select(F.col("_fp").alias("a"), "s", F.explode(
        F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]),
                    lambda m: F.col("segment").bitwiseXOR(m))).alias("segment"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return probe.join(table, ["s", "segment"]).where(F.col("a") < F.col("b")).where(near).select("a", "b")


def groups(prints: DataFrame) -> DataFrame:
    """``prints(doc_id, _fp)`` with ``component_id``, the smallest doc_id reachable over links."""
    firsts = stage(prints.groupBy("_fp").agg(F.min("doc_id").alias("first_id")), "prints")
    roots = components(links(firsts.select("_fp")))
    linked = roots.join(firsts.withColumnRenamed("_fp", "node"), "node")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = roots.join(smallest, "root").select(F.col("node").alias("_fp"), "least_id")
    ids = firsts.join(linked, "_fp", "left").select(
        "_fp", F.coalesce("least_id", "first_id").alias("component_id"))
    return prints.join(ids, "_fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = with_fingerprint(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    prints = stage(prints.select("doc_id", "_fp"), "fingerprints")
    return groups(prints).select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents with one of each group: the one of smallest doc_id; of rows with that id, one."""
    prints = stage(with_fingerprint(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
                   .select("doc_id", "_fp", F.xxhash64("text").alias("_hash")), "fingerprints")
    kept = groups(prints).where(F.col("component_id").eqNullSafe(F.col("doc_id")))
    kept = stage(kept.select("doc_id", "_hash"), "kept")
    per_id = kept.groupBy("doc_id").agg(F.min("_hash").alias("_hash"), F.count("*").alias("_n"))
    rows = packed(docs).withColumn("_hash", F.xxhash64("text"))
    stay = rows.join(per_id.where("doc_id is not null"), ["doc_id", "_hash"])
    twice = stay.where("_n > 1").withColumn("_at", F.row_number().over(
        Window.partitionBy("doc_id").orderBy("_hash"))).where("_at = 1")
    nameless = rows.where("doc_id is null").join(
        kept.where("doc_id is null").select("_hash").distinct(), "_hash", "left_semi")
    return unpacked(stay.where("_n = 1").select("_row").unionByName(twice.select("_row")).unionByName(
        nameless.select("_row")))
