import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import neighbours

VECTORS = "vec_id bigint, embedding array<double>"


def brute(rows, k=5, step=50):
    """Every query against every row, in double precision."""
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=float)
    sizes = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in np.flatnonzero(ids % step == 0):
        score = (x * x[q]).sum(axis=1) / (sizes * sizes[q])
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_embeddings(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    got = found(neighbours.nearest_neighbours(table))
    want = brute([tuple(r) for r in table.select("vec_id", "embedding").collect()])
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    hits = sum(len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    exact = {(q, v): s for q in want for v, s in want[q]}
    assert all(math.isclose(s, exact.get((q, v), s), rel_tol=1e-12) for q in got for v, s in got[q])
    assert all(x == sorted(x, key=lambda p: (-p[1], p[0])) for x in got.values())


def clustered(count, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, 12))
    return [(k, (centres[rng.integers(30)] * 3 + rng.normal(size=12)).tolist()) for k in range(count)]


def test_few_visits(spark):
    """Where vectors lie in clusters, few leaves hold the neighbours; visits follow the wanted recall."""
    rows = clustered(4000)
    table = neighbours.usable(spark.createDataFrame(rows, VECTORS))
    index = neighbours.build(table, leaf=64)
    queries = table.where("vec_id % 50 = 0")
    visits = [neighbours.calibrated_visits(index, queries, recall=r) for r in (0.5, 0.95, 1.0)]
    assert index.sizes.sum() == 4000 and visits == sorted(visits)
    assert visits[1] <= index.tree.leaves / 4
    want = brute(rows)
    for most, least in ((visits[0], 0.5), (visits[1], 0.95), (visits[2], 1.0)):
        got = found(neighbours.search(index, queries, most))
        hits = sum(len(set(dict(want[q])) & set(dict(got[q]))) for q in want)
        assert hits >= least * 5 * len(want)


@pytest.mark.parametrize("rows,queries", [(50, 7), (8192, 4096)])
def test_blocks(spark, monkeypatch, rows, queries):
    """Blocks of any size give the same rows; with all leaves visited, those of brute force."""
    monkeypatch.setattr(neighbours, "ROWS", rows)
    monkeypatch.setattr(neighbours, "QUERIES", queries)
    data = clustered(900, 1) + [(k, [1.0] + [0.5] * 11) for k in range(900, 1300)]  # a third are copies
    table = neighbours.usable(spark.createDataFrame(data, VECTORS))
    index = neighbours.build(table)
    assert index.sizes.sum() == 901
    got = found(neighbours.search(index, table.where("vec_id % 50 = 0"), index.tree.leaves))
    want = brute(data)
    assert {q: [v for v, _ in x] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in want.items()}


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, []),
            (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]),
            (-50, [-1.0, 0.0]), (50, [1e200, 1e200]), (100, [1.0, 0.0]), (100, [0.0, 1.0])]  # of 100 the least counts
    table = spark.createDataFrame(rows, VECTORS).select("*", *[F.lit(1).alias(c) for c in ("leaf", "ids", "v", "q")])
    got = found(neighbours.nearest_neighbours(table))
    half = math.sqrt(0.5)
    assert [v for v, _ in got[0]] == [1, 50, 2, 100, -50]
    assert [s for _, s in got[0]] == pytest.approx([1, half, 0, 0, -1])
    assert [v for v, _ in got[100]] == [2, 50, -50, 0, 1] and set(got) == {0, -50, 50, 100}
    nothing = spark.createDataFrame([], VECTORS)
    assert neighbours.nearest_neighbours(nothing).count() == 0
    assert neighbours.nearest_neighbours(nothing).columns == ["query_id", "rank", "vec_id", "score"]
    alone = spark.createDataFrame([(0, [1.0])], VECTORS)
    assert neighbours.nearest_neighbours(alone).count() == 0
    assert neighbours.nearest_neighbours(spark.createDataFrame([(1, [1.0])], VECTORS)).count() == 0
