import functools
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from postloom.llm import mixing


@pytest.mark.parametrize("slots", [{"a": 1}, {"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 97, "b": 2, "c": 1},
                                   {f"s{k}": k + 1 for k in range(20)}])
def test_never_a_whole_block_off(slots):
    plan = mixing.pfair(slots)
    period = sum(slots.values())
    assert [s for _, _, s in plan] == list(range(period))
    assert Counter(s for s, _, _ in plan) == slots
    done = Counter()
    for source, block, slot in plan:
        assert block == done[source]
        done[source] += 1
        for s, a in slots.items():
            assert abs(done[s] - Fraction((slot + 1) * a, period)) < 1


def test_frame():
    """As long as the targets ask, slots for all documents, and each source within a block of its target."""
    assert mixing.frame({"a": 0.5, "b": 0.25, "c": 0.25, "d": 0}, {"a": 8, "b": 4, "c": 4, "d": 9}, 2) == (
        {"a": 4, "b": 2, "c": 2}, 1)
    slots, frames = mixing.frame(mixing.tempered({"large": 20_000, "rare": 1}), {"large": 20_000, "rare": 1})
    assert (slots, frames) == ({"large": 625, "rare": 1}, 1)
    rng = random.Random(8)
    for _ in range(60):
        sizes = {f"s{k}": int(10 ** rng.uniform(0, 6)) for k in range(rng.randrange(1, 30))}
        weights = mixing.tempered(sizes, rng.choice([0, 0.5, 0.8, 1]))
        slots, frames = mixing.frame(weights, sizes, 8, 4096)
        total, period = sum(weights.values()), sum(slots.values())
        length = max(n / 8 / (weights[k] / total) for k, n in sizes.items())
        assert period <= 4096 + len(sizes) and length <= frames * period <= length + frames * (1 + len(sizes))
        for k, n in sizes.items():
            assert frames * slots[k] * 8 >= n
            ideal = weights[k] / total * period
            assert slots[k] < ideal + 1.001 or slots[k] == 1 or frames * (slots[k] - 1) * 8 < n
            assert slots[k] > ideal - 1 - weights[k] / total * len(sizes)


def test_a_rare_source_does_not_prolong_the_mixture(spark):
    docs = spark.range(20_001).selectExpr("id AS doc_id", "concat('t', id) AS text", "if(id = 77, 'rare', 'large') AS source")
    rows = mixing.mixture(docs).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).collect()
    assert {r.source: (r.n, r.d) for r in rows} == {"large": (20_000, 20_000), "rare": (32, 1)}


def test_several_frames(spark, monkeypatch):
    """The frame repeats: positions are dense and sources go on where they were."""
    monkeypatch.setattr(mixing, "PERIOD", 16)
    monkeypatch.setattr(mixing, "frame", functools.partial(mixing.frame, longest=16))
    docs = spark.createDataFrame([(k, f"t{k}", "abc"[min(2, k % 7)]) for k in range(500)],
                                 "doc_id bigint, text string, source string")
    rows = sorted(mixing.mixture(docs, block=2).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(len(rows))) and len(rows) < 900
    for source in "abc":
        own = [r.doc_id for r in rows if r.source == source]
        n = len(set(own))
        assert own[n:] == own[:-n] if len(own) > n else len(own) == n
    assert len({r.doc_id for r in rows}) == 500


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 3)
    docs = spark.range(8).selectExpr("id AS doc_id", "'' AS text", "cast(id AS string) AS source")
    with pytest.raises(ValueError, match="8 sources"):
        mixing.mixture(docs)


def test_documents(documents):
    rows = mixing.mixture(documents, block=4).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in documents.select("doc_id").collect()}
    assert len({r.position for r in rows}) == len(rows)
    sizes = Counter(r.source for r in documents.collect())
    slots, frames = mixing.frame(mixing.tempered(sizes), sizes, 4)
    total = max(r.slot for r in rows) + 1
    period = sum(slots.values())
    assert total == frames * period
    for source, n in sizes.items():
        own = sorted((r for r in rows if r.source == source), key=lambda r: r.position)
        # The order of the source, over and over, in whole blocks.
        assert [r.doc_id for r in own[n:]] == [r.doc_id for r in own[:-n]] if len(own) > n else len(own) == n
        assert [r.copy for r in own] == [k // n for k in range(len(own))]
        for end in range(1, total + 1, 7):
            blocks = len({r.slot for r in own if r.slot < end})
            assert abs(blocks - Fraction(end * slots[source], period)) < 1


def test_given_weights(spark):
    docs = spark.createDataFrame([(k, f"t{k}", "ab"[k % 2] if k < 40 else None) for k in range(44)],
                                 "doc_id bigint, text string, source string")
    rows = mixing.mixture(docs, {"a": 3, None: 1}, block=2).collect()
    assert {r.source for r in rows} == {"a", None}
    assert {r.doc_id for r in rows} >= set(range(0, 40, 2)) | {40, 41, 42, 43}


def test_order_and_rows(documents):
    mixed = mixing.mixed(documents)
    want = [r.doc_id for r in sorted(mixing.mixture(documents).collect(), key=lambda r: r.position)]
    assert mixed.columns == documents.columns
    assert [r.doc_id for r in mixed.collect()] == want


def test_edges(edges, nothing):
    rows = mixing.mixture(edges, block=2).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in edges.collect()}
    assert mixing.mixed(edges).columns == edges.columns
    assert mixing.mixture(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
