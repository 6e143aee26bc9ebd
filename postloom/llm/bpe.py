"""Byte-level BPE encoding and decoding.

Frequent distinct words are encoded by a Spark fold of ranked merges over their byte arrays, the rank
map being a literal in the plan; the table of their ids has a bounded size and goes to every task. The
tail of rare words, and words longer than ``LONG`` bytes, are merged with a heap in the Arrow batch they
stand in, each once a batch: folding them too costs more than the rest of the job (figures in the
README). So documents never move. Null text counts as empty: no ids. Repeated rows get equal results.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import stage, whole

# Bounds of the table of frequent words: entries, and bytes of a word.
FREQUENT = 1 << 18
LONG = 256
# Documents whose ids are put together at once; long texts come in smaller batches anyway.
ROWS = 512
ARROW_BYTES = "8m"
_BUCKETS = 8_191
_BITS = 20
_SHIFT = 1 << _BITS
_NONE = _SHIFT - 2


class Ranks:
    """Ranks of a token file and the literals that Spark expressions read them from."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # Rank map from (left id, right id) to the rank of both joined, as a literal: buckets that list
        # a key and, behind it, its rank. A key is never as small as a rank. The bytes of a token merge
        # in the same order alone and inside a word, so it is only ever made from one pair.
        buckets: list[list[int]] = [[] for _ in range(_BUCKETS)]
        for token, rank in self.ids.items():
            pair = merge(token, self.ids, 2) if len(token) > 1 else []
            if len(pair) == 2:
                key = (pair[0] + 1) * _SHIFT + pair[1]
                buckets[key % _BUCKETS] += [key, rank]
        self._map = F.from_json(F.lit(json.dumps(buckets)), "array<array<bigint>>")
        self._bytes = F.from_json(F.lit(json.dumps([self.ids[bytes([b])] for b in range(256)])), "array<bigint>")

    def pair(self, left: Column, right: Column) -> Column:
        """Rank of two adjacent pieces joined, or null."""
        key = (left + 1) * _SHIFT + right
        bucket = F.get(self._map, F.pmod(key, F.lit(_BUCKETS)).cast("int"))
        return _let(bucket, lambda b: _let(F.array_position(b, key).cast("int"), lambda at: F.when(
            at > 0, F.get(b, at))))

    def encode_word(self, word: Column) -> Column:
        """Ids of a non-empty word: the leftmost pair of least rank merges until none has a rank.

        The fold holds one number per piece: the rank of its pair with the next piece, plus one, above
        its id. A merge at ``i`` asks the rank map for two new pairs; the first step, at 0, for all.
        """
        chars = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
        ids = F.transform(chars, lambda c: F.get(self._bytes, F.ascii(c)))

        def packed(x: Column) -> Column:
            rank = F.coalesce(self.pair(x["a"], x["b"]), F.lit(_NONE))
            return (rank + 1) * _SHIFT + x["a"]

        def piece(q: Column, at: Column) -> Column:
            return F.get(q, at) % _SHIFT

        def two(a: Column, b: Column) -> Column:
            return F.struct(a.alias("a"), b.alias("b"))

        def merge(q: Column, i: Column) -> Column:
            joined = F.shiftright(F.get(q, i - 1), _BITS) - 1
            every = F.transform(q, lambda x, k: two(x, piece(q, k + 1)))
            behind = two(joined, piece(q, i + 1))
            new = F.when(i == 0, every).when(i == 1, F.array(behind)).otherwise(
                F.array(two(piece(q, i - 2), joined), behind))
            fresh = F.transform(new, packed)
            return F.when(i == 0, fresh).otherwise(F.concat(
                F.slice(q, 1, F.greatest(i - 2, F.lit(0))), fresh, F.slice(q, i + 2, LONG)))

        def step(q: Column) -> Column:
            least = F.array_min(q)
            return F.when(least >= _NONE * _SHIFT, q).otherwise(_let(
                F.when(least < _SHIFT, 0).otherwise(F.array_position(q, least).cast("int")),
                lambda i: merge(q, i)))

        return F.aggregate(ids, ids, lambda q, _: step(q), lambda q: F.transform(
            q, lambda x: (x % _SHIFT).cast("int")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merge(word: bytes, ranks: dict[bytes, int], until: int = 1) -> list[int]:
    """Ids of a word by the same merges, over a list while it is short; down to ``until`` pieces."""
    if len(word) > LONG:
        return heap_merge(word, ranks)
    get, none = ranks.get, len(ranks) << 1
    parts = [word[i:i + 1] for i in range(len(word))]
    pairs = [get(word[i:i + 2], none) for i in range(len(word) - 1)]
    while len(parts) > until and (least := min(pairs)) < none:
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long word; the same merges, found with a heap over a linked list."""
    parts = [word[i:i + 1] for i in range(len(word))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))

    def rank(i: int) -> int | None:
        return ranks.get(parts[i] + parts[after[i]]) if parts[i] and after[i] < len(parts) else None

    heap = [(r, i) for i in range(len(parts)) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if rank(i) != r:
            continue
        j = after[i]
        parts[i], parts[j], after[i] = parts[i] + parts[j], b"", after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k))
    return [ranks[p] for p in parts if p]


def pieces(text: Column, pattern: str) -> Column:
    """Matches of the splitting pattern; white space as Unicode defines it."""
    return F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0))


def frequent_words(docs: DataFrame, ranks: Ranks, pattern: str, limit: int = FREQUENT) -> pa.Table:
    """At most ``limit`` words found in most documents, two at least, with their ids.

    Counts are compared by eighths of powers of two, so a small histogram finds the least count.
    """
    found = docs.select(F.explode(F.array_distinct(pieces(whole(), pattern))).alias("word"))
    counts = found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(
        (F.col("n") > 1) & (F.octet_length("word") <= LONG))
    counts = stage(counts.select("word", F.floor(F.log2("n") * 8).alias("size")), "words")
    least, total = None, 0
    for size, n in sorted(counts.groupBy("size").count().collect(), reverse=True):
        if total + n > limit:
            break
        least, total = size, total + n
    chosen = counts.where(F.lit(False) if least is None else F.col("size") >= least)
    # Every task receives the literal: few tasks, of bounded size because the table is. The driver
    # lists the plan of each query; this one is cut short there, or its literal would take megabytes.
    conf = docs.sparkSession.conf
    brief = {"spark.sql.maxPlanStringLength": "20000", "spark.sql.ui.explainMode": "simple"}
    before = {name: conf.get(name) for name in brief}
    try:
        for name, value in brief.items():
            conf.set(name, value)
        return chosen.coalesce(12).select("word", ranks.encode_word(F.col("word")).alias("ids")).toArrow()
    finally:
        for name, value in before.items():
            conf.set(name, value)


def joined_pieces(tokens: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of the ids between each two bounds: their binary pieces, concatenated."""
    pieces = tokens.take(pa.array(ids))
    ends = np.append(0, np.cumsum(pc.binary_length(pieces).to_numpy()))
    places = pa.array(ends[bounds], pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, places.buffers()[1], pieces.buffers()[2]])


def _look_up(known: pa.Table, ranks: dict[bytes, int]):
    """Arrow function: the ids of the table for known words; other words of a batch are merged once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known["word"].combine_chunks()
        lists = known["ids"].combine_chunks()
        flat_ids, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        tokens = pa.array(by_id, pa.binary())
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, len(b), ROWS)):
            column = batch.column("_pieces")
            flat, bounds = column.flatten(), np.append(0, np.cumsum(column.value_lengths().to_numpy()))
            at = np.array(pc.fill_null(pc.index_in(flat, value_set=words), -1))
            rest = flat.filter(pa.array(at < 0)).dictionary_encode()
            own = [merge(w.encode(), ranks) for w in rest.dictionary.to_pylist()]
            at[at < 0] = len(sizes) + rest.indices.to_numpy()
            all_ids = np.concatenate([flat_ids, np.array([i for x in own for i in x], dtype=np.int32)])
            all_sizes = np.concatenate([sizes, np.array([len(x) for x in own], dtype=np.int32)])
            starts, lengths = np.append(0, np.cumsum(all_sizes)), all_sizes[at]
            ends = np.append(0, np.cumsum(lengths))
            ids = all_ids[np.repeat(starts[at] - ends[:-1], lengths) + np.arange(ends[-1])]
            places = pa.array(ends[bounds], pa.int32())
            bytes_at, raw = pa.array(ends[bounds] * 4, pa.int32()), pa.py_buffer(ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "ids": pa.ListArray.from_arrays(places, pa.array(ids, pa.int32())),
                "packed": pa.Array.from_buffers(pa.binary(), len(batch), [None, bytes_at.buffers()[1], raw]),
                "decoded": joined_pieces(tokens, ids, ends[bounds])})

    return run


def encode(docs: DataFrame, ranks: Ranks, pattern: str, limit: int = FREQUENT) -> DataFrame:
    """(doc_id, ids, packed, decoded) per document: packed has the ids as little-endian 32-bit integers,
    decoded the bytes that the ids stand for."""
    known = frequent_words(docs, ranks, pattern, limit)
    shared = docs.sparkSession.sparkContext.broadcast((known, ranks.ids))
    split = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), pieces(whole(), pattern).alias("_pieces"))
    # Lists of words are several times their text: small Arrow batches keep JVM and Python workers small.
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _look_up(*shared.value)(batches)

    return split.mapInArrow(look_up, "doc_id bigint, ids array<int>, packed binary, decoded binary")


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ranks = Ranks(path)
    return encode(docs, ranks, pattern).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                      F.sha2("packed", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
