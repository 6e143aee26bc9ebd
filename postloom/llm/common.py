"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = r"[\x20\x09-\x0D]+"

_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without it gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = "file://" + tempfile.mkdtemp(prefix="postloom-llm-")
    return _own_root[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in files that outlive executors."""
    path = f"{shared_root(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole(text: str = "text") -> Column:
    """A text, empty where null."""
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def let(value: Column, use) -> Column:
    """``use(value)``: the value is computed once, whatever the optimizer does with the columns it comes from."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles(word_list: str | Column, width: int, of) -> Column:
    """``of(joined words)`` for each run of ``width`` words; fewer words make one shingle, none none.

    ``word_list`` names a column, or is the variable of ``let``: inside the lambda it is read, not computed again.
    """
    w = F.col(word_list) if isinstance(word_list, str) else word_list

    def at(x: Column, i: Column) -> Column:
        rest = [F.get(w, i + k) for k in range(1, width)]
        return of(F.concat_ws(" ", x, *rest))

    runs = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (width - 1), F.lit(1))), at)
    return F.when(F.size(w) > 0, runs).otherwise(F.slice(runs, 1, 0))


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` beside the whole row as ``_row``: no column of the input can clash."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"),
                       F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))


def unpacked(rows: DataFrame) -> DataFrame:
    """The rows that ``packed`` stored."""
    return rows.select("_row.*")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, root)`` per node, root the smallest.

    Alternating large-star and small-star steps; each step groups by node with partial aggregation
    and joins, so that AQE can split a hub. The edges of a step are written to the shared folder.
    """
    state = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    state = stage(state.distinct(), "edges")
    seen = None
    while True:
        # equal counts and equal exact sums of 64-bit hashes: the same edges
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(mark) == seen:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                state.select("v", "v").distinct())
        seen = tuple(mark)
        both = state.union(state.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(
            F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = stage(small.union(least.select("u", "m")).distinct(), "edges")
