import hashlib
import re

from pyspark.sql import functions as F

from postloom.llm import exact


def expected(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc is None, doc))
    out = []
    for plain, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        out += [(d, keep, len(members), d == keep, hashlib.sha256(plain.encode()).hexdigest()) for _, _, d in members]
    return sorted(out, key=str)


def table(docs, make_id=exact.digest_id):
    return sorted((tuple(r) for r in exact.exact_duplicates(docs, make_id).collect()), key=str)


def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_documents(documents):
    assert table(documents) == expected(rows(documents))


def test_edges(edges, nothing):
    assert table(edges) == expected(rows(edges))
    assert table(nothing) == []


def test_long_texts_that_differ_late(spark):
    base = " ".join(f"word{k}" for k in range(5000))
    docs = spark.createDataFrame([(0, base), (1, base + "x"), (2, base.replace(" ", "\n ")), (3, "x" + base), (4, base)],
                                 "doc_id bigint, text string")
    assert table(docs) == expected(rows(docs))


def test_chunks_cover_a_text_and_meet_again(spark):
    base = "".join(f"word{k}phrase{k * 7}" for k in range(3000))
    docs = spark.createDataFrame([(base,), ("inserted" + base,), ("漢" * 10_000,)], "t string")
    a, b, c = [r.c for r in docs.select("t", exact.chunks(F.col("t")).alias("c")).collect()]
    assert "".join(a) == base and "".join(b) == "inserted" + base and "".join(c) == "漢" * 10_000
    assert len(set(a) & set(b)) >= len(a) - 3 and max(map(len, a + b + c)) <= exact.MOST


def test_identifiers_that_collide_are_not_trusted(spark, documents):
    """Under seed 0 every chunk has one identifier; another seed is taken."""
    def weak(chunk, seed):
        return F.unhex(F.lit("00")) if seed == 0 else exact.digest_id(chunk, seed)

    assert exact.verified_seed(documents, weak) == 1
    assert table(documents, weak) == expected(rows(documents))
