import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import audit

LABELS = "doc_id bigint, quality int, toxic int"


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), len(text), sum(c in "#$%&*|" for c in text)]


def brute(docs, labels):
    """Each order applied to the documents one filter after the other."""
    least = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    cases = {}
    for doc_id, text, lang in docs:
        text = text or ""
        words, distinct, capitals, points, symbols = brute_counts(text)
        fails = {f for f, x in zip("ABCDE", (words < 200, 100 * distinct < 50 * words, 100 * capitals > 3 * points,
                                              symbols, doc_id is not None and doc_id > least[text])) if x}
        own = [r for r in labels if r[0] == doc_id and doc_id is not None]
        cases.setdefault(lang or "", []).append((fails, any(r[1] == 1 for r in own), any(r[2] == 1 for r in own)))
    out = set()
    for part, every in cases.items():
        share, rows = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = every
            for step, f in enumerate(order, 1):
                lost = [c for c in left if f in c[0]]
                left = [c for c in left if f not in c[0]]
                share[f] += len(lost)
                rows.append((part, order, step, len(left), len(lost), sum(f in c[0] for c in every) - len(lost),
                             sum(c[0] == {f} for c in every), sum(c[1] for c in lost), sum(c[2] for c in lost)))
        out |= {(*r, share[r[1][r[2] - 1]]) for r in rows}
    return out


def rows_of(docs, labels):
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
             "shapley"]
    return [tuple(r[n] for n in names) for r in audit.filter_audit(docs, labels).collect()]


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_transducer(monkeypatch, block):
    monkeypatch.setattr(audit, "BLOCK", block)
    rng = random.Random(block)
    letters = ["a", "b", "A", "Z", "é", "漢", "𝔘", " ", "\n", "\x0b", "\x1c", "\x85", "$", "|", "", "aaaaaaaa" * 9]
    for _ in range(200):
        texts = ["".join(rng.choices(letters, k=rng.randrange(0, 120))) for _ in range(rng.randrange(1, 6))]
        got = np.concatenate(list(audit.blocks([t.encode() for t in texts])), axis=1).T.tolist()
        assert got == [brute_counts(t) for t in texts]


def test_equal_hashes(monkeypatch):
    """With every hash equal, words are still told apart by their bytes."""
    monkeypatch.setattr(audit, "FACTORS", (np.uint64(0), np.uint64(0)))
    raw = np.frombuffer(b"ab cd ab ef cd abcdefghij abcdefghik" + b" " * 9, np.uint8)
    starts, sizes = np.array([0, 3, 6, 9, 12, 15, 26]), np.array([2, 2, 2, 2, 2, 10, 10])
    owner = np.zeros(7, np.int64)
    assert audit.distinct_words(raw, owner, starts, sizes).sum() == 5
    assert audit.distinct_words(raw, np.arange(7), starts, sizes).all()


def test_documents(spark, data, documents):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = rows_of(documents, labels)
    want = brute([tuple(r) for r in documents.select("doc_id", "text", "lang").collect()],
                 [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert set(got) == want and len(got) == len(want)


def test_edges(spark, edges, nothing):
    marks = [(0, 1, None), (4, 0, 1), (4, 1, 0), (None, 1, 1), (77, 1, 1), (2, None, None)]
    labels = spark.createDataFrame(marks, LABELS).withColumn("text", F.lit("clash")).withColumn("lang", F.lit("x"))
    want = brute([tuple(r) for r in edges.select("doc_id", "text", "lang").collect()], marks)
    got = rows_of(edges, labels)
    assert set(got) == want and len(got) == len(want)
    assert rows_of(nothing, labels) == []
    assert set(rows_of(edges, spark.createDataFrame([], LABELS))) == {(*r[:7], 0, 0, r[9]) for r in want}


def test_copies(spark):
    """A third of the rows share a text, in several languages and under repeated ids."""
    docs = [(k % 40, "the same" if k % 3 else f"text {k % 5}", ["en", "fr", None][k % 3 - 1]) for k in range(300)]
    got = rows_of(spark.createDataFrame(docs, "doc_id bigint, text string, lang string").repartition(7),
                  spark.createDataFrame([(3, 1, 1)], LABELS))
    assert set(got) == brute(docs, [(3, 1, 1)])
