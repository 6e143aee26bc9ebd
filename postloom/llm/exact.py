"""Exact dedup over recipes of content-defined chunks.

A text without ASCII white space is cut behind pairs of characters that its own content decides on; a
chunk gets an identifier, the identifiers are verified to stand for one content each, and documents
are compared by their ordered identifier lists. Null text counts as empty; empty texts are equal.
Repeated rows count in ``group_size`` and share one decision; an id wins over a null doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import BLANKS, stage, whole

# Shortest chunk, longest chunk, and the pair of character classes behind which a chunk may end.
LEAST, MOST = 256, 4096
EDGE = r"[dhlpt048.,。-][aeimuy159:;]"


def normalised(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.regexp_replace(text, BLANKS, "")


def chunks(text: Column) -> Column:
    """Content-defined chunks in order; a stretch without an edge is cut at the longest length."""
    return F.regexp_extract_all(
        text, F.lit(rf"(?s).{{{LEAST},{MOST - 2}}}?{EDGE}|.{{1,{MOST}}}"), F.lit(0))


def digest_id(chunk: Column, seed: int) -> Column:
    """128-bit identifier of a chunk."""
    return F.unhex(F.md5(F.concat(F.lit(f"{seed}:"), chunk)))


def verified_seed(docs: DataFrame, make_id: Callable[[Column, int], Column] = digest_id) -> int:
    """The first seed under which no identifier stands for two different chunks.

    Distinct chunks move once, pre-aggregated where they are read; only their identifiers move again.
    """
    cut = docs.select(F.explode(F.array_distinct(chunks(normalised(whole())))).alias("chunk"))
    seed = 0
    while True:
        distinct = cut.groupBy(make_id(F.col("chunk"), seed).alias("id"), "chunk").agg(
            F.count(F.lit(1)).alias("n"))
        if distinct.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return seed
        seed += 1


def exact_duplicates(docs: DataFrame, make_id: Callable[[Column, int], Column] = digest_id) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most code points before normalising stays, then the smallest id.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    seed = verified_seed(docs, make_id)
    plain = docs.select("doc_id", F.length(whole()).cast("bigint").alias("length"),
                        normalised(whole()).alias("plain"))
    recipes = stage(plain.select(
        "doc_id", "length", F.transform(chunks(F.col("plain")), lambda c: make_id(c, seed)).alias("recipe"),
        F.sha2("plain", 256).alias("text_sha256")), "recipes")
    best = F.min(F.struct(-F.col("length"), F.col("doc_id").isNull(), F.col("doc_id").alias("id")))
    groups = recipes.groupBy("recipe").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.where("group_size > 1").select("recipe", F.col("best.id").alias("best_id"), "group_size")
    out = recipes.join(groups, "recipe", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("best_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
                      keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")
