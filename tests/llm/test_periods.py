import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from postloom.llm import periods

DIGESTS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def brute_runs(words, least_length=6, least_exponent=4):
    """Every stretch of every period that cannot be extended and has no smaller period."""
    n, found = len(words), []
    for p in range(1, n // least_exponent + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            size = i - start + p
            if size >= max(least_length, least_exponent * p):
                own = words[start:start + size]
                if not any(own[q:] == own[:-q] for q in range(1, p)):
                    found.append((start, size, p))
            i += i == start
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(words)
    dropped = {i for s, size, p in found for i in range(s + p, s + size)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{size},{p}\n" for s, size, p in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(found), *head, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def sequences(count, seed):
    rng = random.Random(seed)
    for _ in range(count):
        size, letters, out = rng.randrange(0, 70), rng.choice([1, 2, 2, 3, 5]), []
        while len(out) < size:
            out += [rng.randrange(letters) for _ in range(rng.randrange(1, 6))] * rng.choice([1, 1, 2, 4, 5, 7])
        yield out[:size]


def test_lyndon_groups():
    """The longest Lyndon prefix of each suffix, by definition."""

    def is_lyndon(w):
        return all(w < w[k:] for k in range(1, len(w)))

    for seq in sequences(200, 1):
        _, codes = np.unique(np.array(seq, dtype=int), return_inverse=True)
        codes = codes.tolist()
        length, group = periods.lyndon_groups(codes)
        longest = [max(k for k in range(1, len(codes) - i + 1) if is_lyndon(codes[i:i + k])) for i in range(len(codes))]
        assert length == longest
        words = [tuple(codes[i:i + k]) for i, k in enumerate(longest)]
        assert len(set(zip(group, words))) == len(set(group)) == len(set(words))


def test_runs():
    for seq in sequences(1500, 2):
        for bounds in ((6, 4), (3, 3), (2, 2), (10, 5)):
            assert periods.runs(np.array(seq, dtype=int), *bounds) == brute_runs(seq, *bounds)


def test_cuts(monkeypatch):
    """Pieces that still have rare words are searched as well."""
    monkeypatch.setattr(periods, "CUTS", 0)
    for seq in sequences(300, 3):
        assert periods.runs(np.array(seq, dtype=int)) == brute_runs(seq)


def test_documents(documents):
    rows = {r.doc_id: r for r in periods.run_digests(documents).collect()}
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect() if len(r.text or "") < 40_000}
    assert len(rows) == documents.count() and len(texts) > 150
    for doc_id, text in texts.items():
        assert tuple(rows[doc_id][c] for c in DIGESTS) == brute(doc_id, text)
    assert any(rows[d].n_runs for d in texts)


def test_operator(spark):
    text = "buy now buy now\tbuy now buy now or never"
    row = periods.periodic_runs(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert row.runs == [(0, 8, 2)] and row.collapsed == "buy now or never"
    assert [f.name for f in periods.collapse_runs(spark.createDataFrame([(1, text)], "doc_id int, text string")).schema] == [
        "doc_id", "text"]


def test_edges(edges, nothing):
    out = periods.run_digests(edges).collect()
    want = [(r.doc_id, *brute(r.doc_id, r.text)) for r in edges.select("doc_id", "text").collect()]
    assert sorted(map(repr, ((r.doc_id, *[r[c] for c in DIGESTS]) for r in out))) == sorted(map(repr, want))
    plain = {r.doc_id: r for r in periods.periodic_runs(edges).collect()}
    assert plain[8].runs == [(0, 18_000, 9)] and plain[8].collapsed == "la plume de ma tante est sur le bureau"
    assert plain[1].runs == [] and plain[1].collapsed == ""
    assert periods.run_digests(nothing).count() == 0
