"""How filters of a cleaning pipeline interact: what each removes, at every place in every order.

Texts go through a table-driven byte transducer: a byte's class, from a table of 256 entries, and the state before
it give what is emitted (a word opens or closes; a code point, capital or symbol is counted). The next state depends
on the byte alone, so the states of a block are one table lookup and the pass is a vector operation. Word spans are
inserted into an open-addressing hash table per block of texts and verified against the span that holds the
slot, eight bytes at a time, so equal hashes never merge different words.

A document is then five bits; everything after works on counts per part and combination of bits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 3
# Bytes of text in one pass; a longer text is cut at white space and its words are met in a set.
BLOCK = 1 << 20
# Odd factors of the hash of a word: for its text and for each lane.
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
# Longer words are compared as whole byte strings.
LANES = 8

_SPACE, _OTHER, _TAIL, _CAPITAL, _SYMBOL = range(5)
_OPEN, _CLOSE, _POINT, _IS_CAPITAL, _IS_SYMBOL = 1, 2, 4, 8, 16


def _classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = _SPACE
    table[0x80:0xC0] = _TAIL  # of a code point that an earlier byte began
    table[ord("A"):ord("Z") + 1] = _CAPITAL
    table[list(SYMBOLS)] = _SYMBOL
    return table


CLASS = _classes()
# state after a byte: 0 between words, 1 inside one
STATE = (CLASS != _SPACE).astype(np.uint8)
# what is emitted, by state before and class
EMIT = np.array([[_POINT, _OPEN | _POINT, _OPEN, _OPEN | _POINT | _IS_CAPITAL, _OPEN | _POINT | _IS_SYMBOL],
                 [_CLOSE | _POINT, _POINT, 0, _POINT | _IS_CAPITAL, _POINT | _IS_SYMBOL]], np.uint8)
_REST = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2 ** 64 - 1], np.uint64)


def distinct_words(raw: np.ndarray, owner: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which spans are the first of their word in the table, for spans of ``owner``'s text in ``raw``.

    ``raw`` ends in at least eight spare bytes; spans have at most eight bytes a lane.
    """
    lanes = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # the eight bytes from each place

    def lane(k: int, spans: np.ndarray) -> np.ndarray:
        return lanes[starts[spans] + 8 * k] & _REST[np.minimum(sizes[spans] - 8 * k, 8)]

    count = len(starts)
    hashed = owner.astype(np.uint64) * FACTORS[0] ^ sizes.astype(np.uint64)
    for k in range(LANES):
        more = np.flatnonzero(sizes > 8 * k)
        if not len(more):
            break
        mixed = (hashed[more] ^ lane(k, more)) * FACTORS[1]
        hashed[more] = mixed ^ mixed >> np.uint64(29)
    mask = (1 << (2 * count).bit_length()) - 1
    slot = (hashed & np.uint64(mask)).astype(np.int64)
    table = np.full(mask + 1, -1, np.int64)
    first = np.zeros(count, bool)
    todo = np.arange(count)
    while len(todo):
        at = slot[todo]
        free = table[at] < 0
        table[at[free]] = todo[free]  # of rivals for a slot one stays
        holder = table[at]
        first[todo[holder == todo]] = True
        same = (hashed[holder] == hashed[todo]) & (owner[holder] == owner[todo]) & (sizes[holder] == sizes[todo])
        for k in range(LANES):
            check = np.flatnonzero(same & (sizes[todo] > 8 * k))
            if not len(check):
                break
            same[check] = lane(k, holder[check]) == lane(k, todo[check])
        todo = todo[~same]
        slot[todo] = slot[todo] + 1 & mask
    return first


def transduce(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of words, distinct words, capitals, code points and symbols, a column per text; and, for the first
    span of each distinct word, starts and sizes in the joined texts.

    The pass runs over all texts with one blank behind each, where every word closes.
    """
    raw = np.frombuffer(b" ".join(texts) + b" " * 9, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1  # of the blank behind each text
    used = int(ends[-1]) + 1
    classes = CLASS[raw[:used]]
    before = np.zeros(used, np.uint8)
    before[1:] = STATE[raw[:used - 1]]
    emitted = EMIT[before, classes]
    starts = np.flatnonzero(emitted & _OPEN)
    sizes = np.flatnonzero(emitted & _CLOSE) - starts
    owner = np.searchsorted(ends, starts)
    begins = np.append(0, ends[:-1] + 1)

    def counted(bit: int) -> np.ndarray:
        return np.add.reduceat((emitted & bit) != 0, begins, dtype=np.int64)

    first = np.zeros(len(starts), bool)
    short = np.flatnonzero(sizes <= 8 * LANES)
    if len(short):
        first[short] = distinct_words(raw, owner[short], starts[short], sizes[short])
    seen: set[tuple[int, bytes]] = set()
    for k in np.flatnonzero(sizes > 8 * LANES).tolist():
        word = (int(owner[k]), raw[starts[k]:starts[k] + sizes[k]].tobytes())
        first[k] = word not in seen
        seen.add(word)
    counts = np.array([np.bincount(owner, minlength=len(texts)), np.bincount(owner[first], minlength=len(texts)),
                       counted(_IS_CAPITAL), counted(_POINT) - 1, counted(_IS_SYMBOL)])
    return counts, starts[first], sizes[first]


def long_text(text: bytes) -> np.ndarray:
    """The counts of one text, in pieces that end in white space, however long; its distinct words are kept."""
    total, words, at = np.zeros(5, np.int64), set(), 0
    while at < len(text):
        end = min(at + BLOCK, len(text))
        while end < len(text) and STATE[text[end - 1]]:
            end += 1
        piece = text[at:end]
        counts, starts, sizes = transduce([piece])
        total += counts[:, 0]
        words.update(piece[s:s + n] for s, n in zip(starts.tolist(), sizes.tolist()))
        at = end
    total[1] = len(words)
    return total


def blocks(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Counts of the texts, in their order, from passes of bounded size."""
    block: list[bytes] = []
    size = 0
    for text in texts:
        if block and size + len(text) > BLOCK:
            yield transduce(block)[0]
            block, size = [], 0
        if len(text) > BLOCK:
            yield long_text(text)[:, None]
        else:
            block.append(text)
            size += len(text)
    if block:
        yield transduce(block)[0]


def text_counts(docs: DataFrame, *keep: Column) -> DataFrame:
    """Columns ``keep`` and, per row, ``words distinct capitals points symbols`` of the whole text; null is empty.

    Words are maximal runs of bytes other than ASCII white space and are compared case-sensitively.
    """
    names = ["words", "distinct", "capitals", "points", "symbols"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(batch.num_columns - 1)]
            counts = np.concatenate([np.zeros((5, 0), np.int64), *blocks(texts)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(c) for c in counts]], [*batch.schema.names[:-1], *names])

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text")
    rows = docs.select(*keep)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema],
                        *[f"{n} bigint" for n in names]])
    return docs.select(*keep, text).mapInArrow(count, schema)


def failed_alone() -> Column:
    """Bits of the filters that look at a document alone: bit k for the k-th of ``FILTERS``."""
    fails = [F.col("words") < LEAST_WORDS, 100 * F.col("distinct") < LEAST_DISTINCT * F.col("words"),
             100 * F.col("capitals") > MOST_CAPITALS * F.col("points"), F.col("symbols") > 0]
    bits = [F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)]
    return sum(bits[1:], bits[0]).cast("int")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, bits, good, toxic, n``: documents of each part by the filters that they fail.

    A copy is a text that a smaller doc_id has too; equal texts are equal SHA-256 digests. Texts are only read for
    the counts: what is shuffled is a digest and a few numbers. Copies are first counted per digest, part and
    label before and after the shuffle, so a text that a third of the rows share is a few rows, and the least id
    of a digest is found among those. A row without an id is no copy and makes none. Rows with the same id and
    text don't make each other copies. Several label rows of an id count as one that has each label any has.
    """
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("digest")
    rows = text_counts(docs, F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), digest)
    rows = rows.select("doc_id", "part", "digest", failed_alone().alias("bits"))
    rows = rows.join(marks, "doc_id", "left").na.fill(False, ["good", "toxic"])
    keys = ["digest", "part", "bits", "good", "toxic"]
    by_id = rows.groupBy("doc_id", *keys).agg(F.count("*").alias("n"))
    known = F.col("doc_id").isNotNull()
    least = F.min(F.when(known, F.struct("doc_id", "n")))
    by_text = by_id.groupBy(*keys).agg(least.alias("least"), F.sum(F.when(known, F.col("n"))).alias("n"),
                                       F.sum(F.when(~known, F.col("n"))).alias("nameless"))
    first = F.col("least.doc_id") == F.min("least.doc_id").over(Window.partitionBy("digest"))
    own = F.when(first, F.col("least.n")).otherwise(0)
    alone = F.coalesce(F.col("nameless"), F.lit(0))
    copies = F.coalesce(F.col("n"), F.lit(0)) - F.coalesce(own, F.lit(0))
    split = by_text.select(*keys[1:], (F.coalesce(F.col("n"), F.lit(0)) + alone - copies).alias("_single"),
                           copies.alias("_copies"))
    cases = F.array(F.struct("bits", F.col("_single").alias("n")), F.struct(
        F.col("bits").bitwiseOR(F.lit(1 << 4)).alias("bits"), F.col("_copies").alias("n")))
    return split.select("part", "good", "toxic", F.inline(cases)).groupBy("part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"))


def interactions(failed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What each filter does at each place of each order, per part, from counts of combinations of failures.

    ``filters`` names bit k by its k-th letter. Shares over all orders (``shapley``) are whole: of the m filters
    that a document fails, each comes first in 1/m of the orders.
    """
    orders = list(permutations(range(len(filters))))
    steps = [(
        "".join(filters[k] for k in order), place + 1, 1 << order[place], sum(1 << k for k in order[:place]))
        for order in orders for place in range(len(filters))]
    listed = F.from_json(F.lit("[" + ",".join(f'["{o}","{s}","{b}","{e}"]' for o, s, b, e in steps) + "]"),
                         "array<array<string>>")
    at = F.col("_at")
    every = failed.select("*", F.explode(listed).alias("_at")).select(
        *failed.columns, at[0].alias("filter_order"), at[1].cast("int").alias("step"),
        at[2].cast("int").alias("_own"), at[3].cast("int").alias("_earlier"))
    bits, own, earlier = F.col("bits"), F.col("_own"), F.col("_earlier")
    fails = bits.bitwiseAND(own) != 0
    gone = bits.bitwiseAND(earlier) != 0
    removed = fails & ~gone

    def counted(which: Column) -> Column:
        return F.sum(F.when(which, F.col("n")).otherwise(0)).cast("bigint")

    share = F.when(fails, (F.lit(len(orders)) / F.bit_count(bits)).cast("bigint") * F.col("n")).otherwise(0)
    return every.groupBy("part", "filter_order", "step").agg(
        counted(~gone & ~fails).alias("kept"), counted(removed).alias("removed"), counted(fails & gone).alias("redundant"),
        counted(bits == own).alias("unique_fails"), counted(removed & F.col("good")).alias("good_lost"),
        counted(removed & F.col("toxic")).alias("toxic_lost"), F.sum(share).cast("bigint").alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step`` and counts for all orders of the five filters; parts are languages, null is ''.

    Any part has all its rows, zeros included; an empty table has none. Only ``doc_id``, ``text`` and ``lang`` of
    the documents are read, so other columns cannot clash. Null texts are empty; long ones are read in blocks.
    """
    return interactions(failures(docs, labels))
