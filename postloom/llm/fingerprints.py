"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the sorted array of the ``K`` smallest distinct hashes; fewer mean that all are there. The
sketch of a union is the ``K`` smallest of both sketches, so parts merge in any order. Null text counts
as empty: an empty sketch, like only to other empty ones. Repeated rows follow each other; a null doc_id
comes before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import ascii_lower, let, shingles, stage, whole, words

K = 128
WIDTH = 5
# Documents of 2**BLOCK consecutive ids are neighbours in one task.
BLOCK = 8
# Scripts that are written without spaces: each character is a word of its own.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def bottom(hashes: Column, k: int = K) -> Column:
    """The ``k`` smallest distinct hashes, sorted."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """``rows`` with the sketch of a text: shingles of words, or of characters where a script has no spaces."""
    spaced = F.when(text.rlike(UNSPACED), F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text)
    return rows.withColumn(name, let(words(ascii_lower(spaced)), lambda w: bottom(shingles(w, WIDTH, F.xxhash64))))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness; two empty sketches are alike."""
    union = merge(a, b, k)
    common = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact while the sketch is not full."""
    share = (F.get(a, k - 1).cast("double") + 2.0 ** 63) / 2.0 ** 64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first part's shingles that the second holds; 1 for an empty first part."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def hexed(sketch: Column) -> Column:
    """Sixteen hex digits per hash, in order."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def merged_by(rows: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """One sketch per key over any number of parts: ``k`` hashes per key and task are moved."""
    hashes = rows.select(key, F.explode(sketch).alias("hash")).distinct()
    order = Window.partitionBy(key).orderBy("hash")
    least = hashes.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k)
    return least.groupBy(key).agg(F.sort_array(F.collect_list("hash")).alias(sketch))


def _heads(keys: DataFrame) -> DataFrame:
    """(head, block): the least key of each block and the block before it, cyclically.

    Blocks are ordered inside groups of blocks; only one row per group of groups meets in one task.
    """
    blocks = keys.groupBy(F.shiftright("_key", BLOCK).alias("block")).agg(F.min("_key").alias("head"))
    blocks = stage(blocks.withColumn("group", F.shiftright("block", BLOCK)), "blocks")
    groups = blocks.groupBy("group").agg(F.max("block").alias("last"))
    everything = Window.partitionBy(F.lit(0)).orderBy("group")
    last = groups.agg(F.max("last")).first()[0]
    groups = groups.select("group", F.coalesce(F.lag("last").over(everything), F.lit(last)).alias("before"))
    inside = F.lag("block").over(Window.partitionBy("group").orderBy("block"))
    placed = blocks.withColumn("previous", inside).join(groups, "group")
    return placed.select("head", F.coalesce("previous", "before").alias("_block"))


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with the columns of the row of next higher doc_id as ``next_*``; the last meets the first.

    The first row of each block is also sent, as a guest, to the block before, so texts move once.
    """
    keyed = rows.withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    heads = stage(_heads(keyed.select("_key")), "heads")
    own = keyed.withColumn("_block", F.shiftright("_key", BLOCK)).withColumn("_guest", F.lit(False))
    guests = keyed.join(heads, F.col("_key") == F.col("head")).drop("head").withColumn("_guest", F.lit(True))
    order = Window.partitionBy("_block").orderBy("_guest", "_key", "text")
    both = own.unionByName(guests).withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return both.where("not _guest").drop("_guest", "_key", "_block")


def edited(text: Column, following: Column) -> Column:
    """The later half of the code points replaced by as many from the start of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_shingles, in_next."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text"))
    rows = with_next(with_sketch(rows, F.col("text"), "sketch"), ["text", "sketch"])
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = with_sketch(rows, F.col("edited"), "edited_sketch")
    sketch, other, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        hexed(sketch).alias("fingerprint"), hexed(other).alias("edited_fingerprint"),
        resemblance(sketch, other).alias("near_edited"), resemblance(sketch, following).alias("near_next"),
        distinct_shingles(sketch).alias("n_shingles"), containment(sketch, following).alias("in_next"))
