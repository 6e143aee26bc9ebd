"""Segments of a keyed table: files by hash of the key, sorted, with a Bloom filter, so that a lookup reads few files.

A key's hash names a block of the filter (32,768 bits, for about 2,000 keys), and blocks are dealt to the files of
the segment (about a million rows each). A lookup tests each key against its block of every segment and then opens
only the files whose block may hold it. Keys that were never stored, most keys of a fetch, open none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.session import TEXT_CODEC, stage
from postloom.sources.versions import Segment, Versions

BLOCK_BITS = 1 << 15
BLOCK_KEYS = 2_048
BLOCKS_PER_FILE = 512
PROBES = 5


def shape(rows: int) -> tuple[int, int]:
    """Blocks and files of a segment of so many rows."""
    blocks = max(1, -(-rows // BLOCK_KEYS))
    return blocks, -(-blocks // BLOCKS_PER_FILE)


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys)


def block_of(hashed: Column, blocks: Column) -> Column:
    return F.pmod(hashed, blocks).cast("int")


def bits_of(keys: list[str]) -> Column:
    """Places of a key in its block, from hashes that differ from the one that names the block."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(k), *keys), F.lit(BLOCK_BITS)) for k in range(PROBES)])


def is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def write(rows: DataFrame, keys: list[str], path: str, filters: str, most_rows: int) -> tuple[int, int, int]:
    """Write a segment and its filter; ``most_rows`` bounds its rows. Returns rows, blocks and files."""
    blocks, files = shape(most_rows)
    place = F.pmod(block_of(key_hash(keys), F.lit(blocks)), F.lit(files)).cast("int")
    rows.repartitionById(files, place).sortWithinPartitions(*keys).write.mode("overwrite").option(
        "compression", TEXT_CODEC).parquet(path)
    stored = rows.sparkSession.read.schema(rows.schema).parquet(path)
    places = stored.select(block_of(key_hash(keys), F.lit(blocks)).alias("block"), F.explode(bits_of(keys)).alias("at"))
    places.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")).coalesce(files).write.mode(
        "overwrite").parquet(filters)
    return stored.count(), blocks, files


def lookup(keys: DataFrame, names: list[str], versions: Versions, table: str, segments: tuple[Segment, ...],
           schema: str) -> DataFrame:
    """Those of ``keys`` (columns ``names``) that a segment holds, each once.

    Filters of all segments are one table, joined on segment and block. What passes is staged, so Spark knows its
    size and broadcasts it where its own check allows: the files of the segments are then not shuffled.
    """
    spark = keys.sparkSession
    wanted = keys.select(*names).distinct()
    segments = tuple(s for s in segments if s.rows)
    if not segments:
        return wanted.limit(0)
    filters = None
    for number, s in enumerate(segments):
        part = spark.read.schema("block int, bits binary").parquet(f"{versions.root}/_filters/{table}/{s.name}")
        part = part.select(F.lit(number).alias("segment"), "block", "bits")
        filters = part if filters is None else filters.unionAll(part)
    shapes = F.array(*[F.struct(F.lit(n).alias("segment"), F.lit(s.blocks).alias("blocks"),
                                F.lit(s.buckets).alias("files")) for n, s in enumerate(segments)])
    probes = wanted.select(*names, key_hash(names).alias("_hash"), bits_of(names).alias("_at"), F.inline(shapes))
    probes = probes.withColumn("block", block_of(F.col("_hash"), F.col("blocks")))
    maybe = probes.join(filters, ["segment", "block"]).where(F.forall("_at", lambda at: is_set(F.col("bits"), at)))
    maybe = stage(maybe.select(*names, "segment", F.pmod("block", "files").cast("int").alias("file")), "maybe")
    paths = []
    for found in maybe.select("segment", "file").distinct().collect():  # at most one per file of the table
        folder = f"{table}/{segments[found.segment].name}"
        paths += [f"{versions.root}/{folder}/{f}" for f, _ in versions.files(folder)
                  if f.startswith(f"part-{found.file:05d}-")]
    if not paths:
        return wanted.limit(0)
    stored = spark.read.schema(schema).parquet(*sorted(paths)).select(*names)
    return stored.join(maybe.select(*names).distinct(), names, "left_semi")
