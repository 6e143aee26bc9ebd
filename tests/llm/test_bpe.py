import hashlib
import random

import numpy as np
import public_tokenizers as tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from postloom.llm import bpe

PATH = tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks(spark):
    return bpe.Ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks.ids, special_tokens={})


CASES = [None, "", "x" * 3000 + " " * 500 + "　\x1c\x1d a  b", "漢字かな交じり文" * 300,
         "it's  we'll 𝔘𝔫𝔦 ٣٤ ½² \x85 \r\n\t", "abcdefghij" * 400, "<|endoftext|>", " \n \n", "a\u0000b", "é é"]


def same(docs, library):
    rows = docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(),
                   hashlib.sha256((r.text or "").encode()).hexdigest())
                  for r in rows for i in [library.encode_ordinary(r.text or "")])
    got = bpe.token_digests(docs, PATH, tokenizers.PATTERN)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_cases(spark, library):
    same(spark.createDataFrame(list(enumerate(CASES)), "doc_id bigint, text string"), library)


def test_documents(documents, library):
    same(documents, library)


def test_the_fold_is_the_merge(spark, ranks):
    """Words folded by Spark have the ids of the two merges in Python."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abctheion ingé字", k=rng.randrange(1, 40))) for _ in range(300)]
    rows = spark.createDataFrame([(w,) for w in words], "word string").select(
        "word", ranks.encode_word(F.col("word")).alias("ids")).collect()
    for r in rows:
        assert list(r.ids) == bpe.merge(r.word.encode(), ranks.ids) == bpe.heap_merge(r.word.encode(), ranks.ids)


@pytest.mark.parametrize("limit", [0, 50, 1 << 18])
def test_any_table_of_frequent_words_gives_the_same_ids(documents, library, ranks, limit):
    docs = documents.where("doc_id < 20")
    table = bpe.frequent_words(docs, ranks, tokenizers.PATTERN, limit)
    assert len(table) <= limit
    for r in bpe.encode(docs, ranks, tokenizers.PATTERN, limit).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert list(r.ids) == library.encode_ordinary(r.text)


def test_edges(edges, nothing, library):
    got = bpe.token_digests(edges, PATH, tokenizers.PATTERN)
    assert got.count() == edges.count()
    assert {r.n_tokens for r in got.collect() if r.doc_id in (1, 2)} == {0}
    assert bpe.token_digests(nothing, PATH, tokenizers.PATTERN).count() == 0
