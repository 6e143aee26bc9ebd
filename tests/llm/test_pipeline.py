import hashlib

import corpus_pipeline
from postloom.llm import simhash
from postloom.llm.common import stage as written


def test_stages(spark, data, documents):
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data).cache()
        seen[name] = docs
        if name != "byte_bpe":
            assert docs.columns == documents.columns
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    assert ids["line_dedup"] == ids["language_id"]
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"].collect())
    groups = {r.component_id for r in simhash.near_duplicates(seen["line_dedup"]).collect()}
    assert ids["simhash_dedup"] == groups == ids["mix_sources"] == ids["byte_bpe"]
    assert len(corpus_pipeline.STAGES) == 5
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).collect())) == sorted(map(tuple, docs.collect()))


def test_edges(spark, edges, nothing):
    """What each stage keeps of nulls, empty and long texts, repeated rows and rows of one id; texts by their digest."""
    def ids(rows):
        return sorted((r.doc_id for r in rows), key=lambda d: (d is None, d))

    docs, seen = edges, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), name)
        seen[name] = docs.collect()
    assert ids(seen["language_id"]) == [0, 4, 4, 4, 7, 8, 9, 5000, 9000, None]  # null, blank and letterless texts go
    assert ids(seen["line_dedup"]) == ids(seen["language_id"])
    lines = {(r.doc_id, r.text) for r in seen["line_dedup"]}
    assert {(4, ""), (4, "another text under the same id"), (None, "a row without an id")} <= lines
    assert ids(seen["simhash_dedup"]) == [0, 4, 7, 8, 9, 5000, 9000, None]  # rows of one id are one document
    texts = {hashlib.sha256(r.text.encode()).hexdigest() for r in seen["simhash_dedup"]}
    mixed = [(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in seen["mix_sources"]]
    assert {t for _, t in mixed} == texts and set(ids(seen["mix_sources"])) == set(ids(seen["simhash_dedup"]))
    assert sorted((r.doc_id or -1, r.decoded_sha256) for r in seen["byte_bpe"]) == sorted((d or -1, t) for d, t in mixed)
    docs = nothing
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), name)
        assert docs.count() == 0
