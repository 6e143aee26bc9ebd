import random

import pytest
from pyspark.sql import functions as F

from postloom.llm import lines


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def varied(rng, line, edits):
    for _ in range(edits):
        at, kind = rng.randrange(len(line)), rng.randrange(3)
        line = line[:at] + ("" if kind == 0 else rng.choice("ab é")) + line[at + (kind != 1):]
    return line


def made(seed, n):
    """Lines in groups: far apart, near, and crowds that differ in one place or in many."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(22, 90))) + "x" for _ in range(6)]
    out = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(3, 60))) for _ in range(20)]
    out += [varied(rng, rng.choice(base), rng.randrange(0, 4)) for _ in range(n)]
    out += [f"an entry of the log number {k} of many more entries" for k in range(95, 125)]
    return out


def expected(docs, threshold):
    """Repeated lines by comparing all pairs."""
    found = {}
    for doc, text in docs:
        for number, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\n\x0b\x0c\r")
            if len(line) >= lines.LEAST:
                found.setdefault(line, []).append((doc, number))
    names = list(found)
    root = {x: x for x in names}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(names):
        for y in names[:i]:
            if abs(len(x) - len(y)) <= threshold and top(x) != top(y) and edit(x, y) <= threshold:
                root[top(x)] = top(y)
    first = {}
    for x in names:
        first[top(x)] = min(first.get(top(x), (1 << 60, 0)), min(found[x]))
    return {(d, k): first[top(x)] for x in names for d, k in found[x] if (d, k) != first[top(x)]}


@pytest.mark.parametrize("threshold,crowd", [(1, 4), (1, 2), (1, 10 ** 6), (2, 4), (3, 4)])
def test_brute_force(spark, threshold, crowd):
    every = made(threshold, 120)
    docs = [(k, "\n".join(every[k::40])) for k in range(40)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r.number): (r.first_doc, r.first_number)
           for r in lines.decisions(table, threshold, crowd).collect()}
    assert got == expected(docs, threshold)


def test_distance(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(8, 60)))
        b = varied(rng, a, rng.randrange(0, 6))
        if len(b) > 5:
            pairs.append((a, b))
    table = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 2, 4):
        for r in table.select("a", "b", lines.within(F.col("a"), F.col("b"), k).alias("near")).collect():
            assert r.near == (edit(r.a, r.b) <= k), (r.a, r.b, k)


def test_documents(documents):
    sample = documents.where("doc_id < 60")
    docs = [(r.doc_id, r.text) for r in sample.collect()]
    got = {(r.doc_id, r.number): (r.first_doc, r.first_number) for r in lines.decisions(sample).collect()}
    assert got == expected(docs, lines.THRESHOLD)


def test_short_lines(spark):
    docs = [(1, "Hi there.\n\n漢字かな交じり文\nabc"), (2, "abd\n Hi there. \n\nHi there!"), (3, "漢字かな交じり文"),
            (None, "Hi there.\nabc"), (None, None)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    left = {(r.doc_id, r.text) for r in lines.drop_repeated_lines(table).collect()}
    assert left == {(1, docs[0][1]), (2, "abd\n\nHi there!"), (3, ""), (None, ""), (None, None)}
    assert {r.doc_id: r.dropped for r in lines.line_digests(table).where("doc_id > 1").collect()} == {2: "1>1:0", 3: "0>1:2"}


def test_long_lists_are_not_sent(spark, monkeypatch):
    """Beyond the bounds of rows or elements, joins shuffle: the same lines go."""
    docs = [(k, "\n".join(["a line that all of the documents share"] * 30 + [f"own {k}"])) for k in range(20)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = sorted(map(tuple, lines.line_digests(table).collect()))
    assert [r[2] for r in want] == [29] + [30] * 19
    for name in ("SENT", "SENT_ELEMENTS"):
        with monkeypatch.context() as m:
            m.setattr(lines, name, 3)
            assert sorted(map(tuple, lines.line_digests(table).collect())) == want


def test_edges(edges, nothing):
    out = lines.drop_repeated_lines(edges)
    assert out.columns == edges.columns and out.count() == edges.count()
    texts = {(r.doc_id, r.text) for r in out.collect()}
    assert (0, "One two three four five six seven eight nine ten.\nAll rights reserved.") in texts
    assert (4, "") in texts and (1, None) in texts and (4, "another text under the same id") in texts
    assert lines.line_digests(edges).count() == edges.count()
    assert lines.drop_repeated_lines(nothing).count() == 0
