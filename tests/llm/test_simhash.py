import re

import numpy as np
import pytest
import xxhash

from postloom.llm import simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    runs = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, distance):
    """Root of each fingerprint, by comparing all pairs."""
    every = sorted(set(prints))
    root = {x: x for x in every}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(every):
        for y in every[:i]:
            if (x ^ y).bit_count() <= distance:
                root[top(x)] = top(y)
    return {x: top(x) for x in every}


def test_documents(documents):
    own = {r.doc_id: fingerprint(r.text) for r in documents.select("doc_id", "text").collect()}
    root = groups(own.values(), simhash.DISTANCE)
    least = {}
    for doc, x in own.items():
        least[root[x]] = min(least.get(root[x], doc), doc)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents).collect()}
    assert got == {doc: (f"{x:016x}", least[root[x]]) for doc, x in own.items()}
    kept = simhash.drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


@pytest.mark.parametrize("distance,segments", [(3, 2), (3, 4), (6, 4), (0, 2), (2, 2)])
def test_links(spark, distance, segments):
    """Fingerprints around few centres: all and only the near pairs."""
    rng = np.random.default_rng(distance)
    centres = rng.integers(-2 ** 63, 2 ** 63, 5)
    prints = {int(c) for c in centres} | {0, -1}
    for _ in range(150):
        x = int(rng.choice(centres)) % 2 ** 64
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            x ^= 1 << int(b)
        prints.add(x - 2 ** 64 if x >= 2 ** 63 else x)
    table = spark.createDataFrame([(p,) for p in prints], "_fp bigint")
    got = {(r.a, r.b) for r in simhash.links(table, distance, segments).collect()}
    assert got == {(a, b) for a in prints for b in prints
                   if a < b and ((a ^ b) % 2 ** 64).bit_count() <= distance}


def test_edges(edges, nothing):
    out = simhash.near_duplicates(edges).collect()
    assert len(out) == edges.count()
    assert {r.component_id for r in out if r.fingerprint == "0" * 16} == {1}
    kept = simhash.drop_near_duplicates(edges)
    assert kept.columns == edges.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) <= 1 and ids.count(0) == 1 and ids.count(1) == 1 and 2 not in ids and ids.count(None) == 1
    assert simhash.near_duplicates(nothing).count() == simhash.drop_near_duplicates(nothing).count() == 0
