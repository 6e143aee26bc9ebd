"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample of distinct vectors; every distinct vector is then a row of the index, under
its leaf. A query takes nodes from a priority queue by the likeness of their centres, and so visits leaves from the
most promising on. How many it visits is calibrated: for a bounded sample of the queries the true neighbours among
all rows are found, and the visits are widened until the stated share of them is in visited leaves.

Leaves are searched by join in blocks of bounded size on both sides, so neither a leaf that holds most rows nor one
that all queries visit meets in one task; a block gives a query's best few, which are merged by query.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import stage

NEIGHBOURS = 5
QUERY_STEP = 50
# Bounds of the sample the tree is fitted on, and of a leaf within it: so the tree has a bounded size.
SAMPLE = 1 << 16
LEAF = 128
BRANCHES = 8
ROUNDS = 10
# Queries whose true neighbours are found, and the share of these that visited leaves must hold.
CALIBRATION = 256
RECALL = 0.95
# Rows of a block of the index and of a block of queries.
ROWS, QUERIES = 8_192, 4_096
_CHUNK, _PAIRS = 256, 1 << 16
# Likeness of unit vectors by matrix product; anything as close to the last place is computed again.
_SLACK = 1e-9

FOUND = "query_id bigint, vec_id bigint, score double"


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


@dataclass
class Tree:
    """Unit centres of the nodes, node 0 the root, with children and leaf numbers (-1 for inner nodes)."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector: down the most similar children."""
        out = np.zeros(len(rows), np.int32)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            if self.leaf[node] >= 0 or not len(own):
                out[own] = self.leaf[node]
                continue
            nearest = np.argmax(rows[own] @ self.centres[self.children[node]].T, axis=1)
            todo += [(child, own[nearest == k]) for k, child in enumerate(self.children[node].tolist())]
        return out

    def visits(self, rows: np.ndarray, sizes: np.ndarray, most: int, least_rows: int) -> Iterator[list[int]]:
        """Per unit vector the leaves in the order of their visits: ``most``, and on to ``least_rows`` rows."""
        for start in range(0, len(rows), _CHUNK):
            for alike in rows[start:start + _CHUNK] @ self.centres.T:
                queue, found, held = [(-alike[0], 0)], [], 0
                while queue and (len(found) < most or held < least_rows):
                    _, node = heapq.heappop(queue)
                    if self.leaf[node] >= 0:
                        found.append(int(self.leaf[node]))
                        held += sizes[found[-1]]
                    for child in self.children[node].tolist():
                        heapq.heappush(queue, (-alike[child], child))
                yield found


def split(rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of unit vectors: centres that have rows, and the centre of each row."""
    centres = rows[rng.choice(len(rows), min(BRANCHES, len(rows)), replace=False)]
    for _ in range(ROUNDS):
        nearest = np.argmax(rows @ centres.T, axis=1)
        used, nearest = np.unique(nearest, return_inverse=True)
        order = np.argsort(nearest, kind="stable")
        sums = np.add.reduceat(rows[order], np.searchsorted(nearest[order], np.arange(len(used))))
        size = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres[used])
    used, nearest = np.unique(np.argmax(rows @ centres.T, axis=1), return_inverse=True)
    return centres[used], nearest


def fit(sample: np.ndarray, leaf: int = LEAF, seed: int = 0) -> Tree:
    """The tree of a sample of unit vectors; a node of at most ``leaf`` of them, or that can't be split, is a leaf."""
    rng = np.random.default_rng(seed)
    centres, children, leaves, todo = [unit(sample.sum(axis=0)[None] + 1e-12)[0]], [np.array([], int)], [-1], [(0, sample)]
    while todo:
        node, rows = todo.pop(0)
        parts = split(rows, rng) if len(rows) > leaf else (rows[:1], None)
        if len(parts[0]) == 1:
            leaves[node] = max(leaves) + 1
            continue
        children[node] = np.arange(len(centres), len(centres) + len(parts[0]))
        for k, centre in enumerate(parts[0]):
            todo.append((len(centres), rows[parts[1] == k]))
            centres.append(centre)
            children.append(np.array([], int))
            leaves.append(-1)
    return Tree(np.array(centres), children, np.array(leaves))


def usable(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, v`` of the rows that can be compared, ``v`` as doubles.

    Rows take no part whose id or vector is null, whose vector is empty, zero, or holds a null or non-finite
    component, or whose vector has another length than most have (the least of equally frequent lengths counts).
    Of several rows with one id, that with the least vector takes part.
    """
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                             F.col(column).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("v") == (sizes["size"] if sizes else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """``v, ids``: each vector once, with the ``keep`` smallest ids of its rows.

    Nearest neighbours of equal likeness go by id, so the other copies are never among them: with one id more than
    neighbours are asked for, as the query's own does not count, nothing is lost. Copies are counted out before
    and after the shuffle, so a vector that a third of the rows share is a few rows.
    """
    by_id = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= keep)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows, each scaled by a power of two: that is exact, and squares stay finite."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    rows = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: pa.Array,
            k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Query ids, row numbers, ids and cosines of the ``k`` nearest of ``rows``, ties to the smaller id.

    A matrix product picks the rows near the k-th place; their cosines are then computed pair by pair, the same
    way for any pair, so equal vectors have equal cosines. ``ids`` lists the ids of each row.
    """
    ends = np.append(0, np.cumsum(ids.value_lengths().to_numpy()))
    flat = ids.flatten().to_numpy()
    sizes, units = np.sqrt((rows * rows).sum(axis=1)), unit(rows)
    take = min(k + 1, len(rows))
    for start in range(0, len(queries), _CHUNK):
        own, own_ids = queries[start:start + _CHUNK], query_ids[start:start + _CHUNK]
        own_sizes = np.sqrt((own * own).sum(axis=1))
        alike = (own / own_sizes[:, None]) @ units.T
        least = np.partition(alike, len(rows) - take, axis=1)[:, len(rows) - take] - _SLACK
        q, x = np.nonzero(alike >= least[:, None])
        score = np.concatenate([np.zeros(0), *[
            (own[q[i:i + _PAIRS]] * rows[x[i:i + _PAIRS]]).sum(axis=1) for i in range(0, len(q), _PAIRS)]])
        score /= own_sizes[q] * sizes[x]
        copies = ends[x + 1] - ends[x]
        pair = np.repeat(np.arange(len(q)), copies)
        vec = flat[np.repeat(ends[x] - np.append(0, np.cumsum(copies))[:-1], copies) + np.arange(len(pair))]
        other = vec != own_ids[q[pair]]
        pair, vec = pair[other], vec[other]
        order = np.lexsort((vec, -score[pair], q[pair]))
        pair, vec = pair[order], vec[order]
        of = q[pair]
        top = np.arange(len(of)) - np.searchsorted(of, of) < k
        yield own_ids[of[top]], x[pair[top]], vec[top], score[pair[top]]


@dataclass
class Index:
    """``rows``: leaf, v, ids of each distinct vector, stored; ``sizes``: rows of each leaf."""

    rows: DataFrame
    tree: Tree
    sizes: np.ndarray


def build(rows: DataFrame, k: int = NEIGHBOURS, sample: int = SAMPLE, leaf: int = LEAF) -> Index | None:
    """The index of usable ``rows``; None without any.

    The sample are the vectors with hashes under a threshold that leaves about ``sample`` of them; it never
    has over twice as many.
    """
    spark = rows.sparkSession
    vectors = stage(distinct_vectors(rows, k + 1), "vectors")
    share = sample / max(1, vectors.count())
    hashed = F.xxhash64("v").bitwiseAND(F.lit((1 << 31) - 1))
    some = vectors.where(hashed < math.ceil(share * (1 << 31))).select("v").limit(2 * sample).toArrow()
    if not len(some):
        return None
    points = unit(matrix(some["v"]))
    tree = fit(points[np.lexsort(points.T)], leaf)  # however the rows came
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                leaves = shared.value.place(unit(matrix(batch.column("v"))))
                yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int32()), *batch.columns], ["leaf", "v", "ids"])

    placed = stage(vectors.mapInArrow(place, "leaf int, v array<double>, ids array<bigint>"), "leaves")
    sizes = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():
        sizes[r["leaf"]] = r["count"]
    return Index(placed, tree, sizes)


def calibrated_visits(index: Index, queries: DataFrame, k: int = NEIGHBOURS, recall: float = RECALL,
                      sample: int = CALIBRATION) -> int:
    """Leaves to visit so that they hold at least ``recall`` of the true neighbours of sampled queries."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).toArrow()
    if not len(some):
        return 1
    asked, asked_ids = matrix(some["v"]), some["vec_id"].to_numpy()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = batch.column("leaf").to_numpy()
            for part in nearest(asked, asked_ids, matrix(batch.column("v")), batch.column("ids"), k) if len(batch) else ():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[0]), pa.array(part[2]), pa.array(part[3]), pa.array(leaves[part[1]])],
                    ["query_id", "vec_id", "score", "leaf"])

    true = best(index.rows.mapInArrow(search, FOUND + ", leaf int"), k).collect()
    order = index.tree.visits(unit(asked), index.sizes, index.tree.leaves, 0)
    place = {q: {leaf: n for n, leaf in enumerate(found, 1)} for q, found in zip(asked_ids.tolist(), order)}
    needed = sorted(place[r.query_id][r.leaf] for r in true)
    most = 1
    while needed and sum(n <= most for n in needed) < recall * len(needed):
        most += 1
    return most


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of the found pairs of each query, ranked from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _at(numbers: list[int], place: Column) -> Column:
    return F.get(F.from_json(F.lit(json.dumps(numbers)), "array<int>"), place)


def search(index: Index, queries: DataFrame, visits: int, k: int = NEIGHBOURS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the nearest rows in the leaves that each of ``queries`` visits."""
    shared = queries.sparkSession.sparkContext.broadcast((index.tree, index.sizes))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, sizes = shared.value
        for batch in batches:
            if len(batch):
                leaves = list(tree.visits(unit(matrix(batch.column("v"))), sizes, visits, k + 1))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(leaves, pa.list_(pa.int32()))], ["query_id", "q", "leaves"])

    asked = stage(queries.select("vec_id", "v").mapInArrow(
        visit, "query_id bigint, q array<double>, leaves array<int>"), "visits")
    visited = np.zeros(index.tree.leaves, np.int64)
    for r in asked.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():
        visited[r["leaf"]] = r["count"]
    row_parts = np.maximum(1, -(-index.sizes // ROWS)).tolist()
    query_parts = np.maximum(1, -(-visited // QUERIES)).tolist()
    leaf = F.col("leaf")

    def parts(numbers: list[int]) -> Column:
        return F.explode(F.sequence(F.lit(0), _at(numbers, leaf) - 1))

    def dealt(numbers: list[int], *by: str) -> Column:
        return F.pmod(F.xxhash64(*by), _at(numbers, leaf)).cast("int")

    keys = ["leaf", "row_part", "query_part"]
    left = index.rows.select("leaf", dealt(row_parts, "v").alias("row_part"), parts(query_parts).alias("query_part"),
                             "v", "ids")
    right = asked.select(F.explode("leaves").alias("leaf"), "query_id", "q").select(
        "leaf", parts(row_parts).alias("row_part"), dealt(query_parts, "query_id", "q").alias("query_part"),
        "query_id", "q")

    def meet(rows: pa.Table, own: pa.Table) -> pa.Table:
        found = [pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names)]
        if len(rows) and len(own):
            ids = rows["ids"].combine_chunks()
            for q, _, vec, score in nearest(matrix(own["q"]), own["query_id"].to_numpy(), matrix(rows["v"]), ids, k):
                found.append(pa.table([pa.array(q), pa.array(vec), pa.array(score)], names))
        return pa.concat_tables(found)

    names = ["query_id", "vec_id", "score"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, FOUND)
    return best(pairs, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_neighbours(embeddings: DataFrame, k: int = NEIGHBOURS, query_step: int = QUERY_STEP,
                       recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other rows found for each row whose id ``query_step``
    divides, by cosine, ties to the smaller id; all other rows where there are no more than ``k``.

    See ``usable`` for rows that take no part and for repeated ids. Other columns are not read. An empty table has
    no result.
    """
    rows = usable(embeddings)
    index = build(rows, k)
    if index is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    queries = rows.where(F.col("vec_id") % query_step == 0)
    return search(index, queries, calibrated_visits(index, queries, k, recall), k)
