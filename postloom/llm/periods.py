"""Periodic runs of words: Lyndon roots from the grouping phase of Baier's suffix sorter, extended to runs.

Phase one of the sorter groups the suffixes of a sequence by their longest Lyndon prefix. It is run under an
order of the words and under the reversed order, and gives both Lyndon arrays directly, without a suffix array.
A run's root is the longest Lyndon word at one of its first positions under one of the orders, so the chains
of equal groups one root apart hold all runs; common extension to both sides gives their ends.

Each text is worked on alone: no shuffle, and memory for one text at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
# A sequence is searched as it is when it still has rare words after so many cuts.
CUTS = 32
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"

# words of a text under its id -> the words to search
Edit = Callable[[int | None, list[bytes]], list[bytes]]


def lyndon_groups(codes: list[int]) -> tuple[list[int], list[int]]:
    """Length and group of the longest Lyndon word that starts at each place; equal groups, equal words.

    ``codes`` use every number from 0 up. Groups are worked off from the largest down; a linked list of the
    places not yet worked off gives each place its predecessor in a smaller group, whose word then grows
    by the word of the group. Predecessors met equally often move together to a new group behind their old one.
    """
    n = len(codes)
    group, length = list(codes), [1] * n
    members: list[list[int]] = [[] for _ in range(max(codes, default=-1) + 1)]
    for i, c in enumerate(codes):
        members[c].append(i)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    above[-1:] = [-1]
    g = len(members) - 1
    while g >= 0:
        met: dict[int, int] = {}
        size = 0
        for i in members[g]:
            if group[i] != g:
                continue
            size, before, after = length[i], left[i], right[i]
            if after < n:
                left[after] = before
            if before >= 0:
                right[before] = after
                met[before] = met.get(before, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in met.items():
            moved.setdefault((times, group[j]), []).append(j)
        for times, old in sorted(moved, reverse=True):  # of one old group, those met more often stand higher
            new, up = len(members), above[old]
            members.append(moved[times, old])
            below.append(old)
            above.append(up)
            above[old] = new
            if up >= 0:
                below[up] = new
            for j in moved[times, old]:
                group[j] = new
                length[j] += times * size
        g = below[g]
    return length, group


def common(codes: np.ndarray, period: int, start: int, step: int) -> int:
    """How far words equal the word one period before, from ``start`` in direction ``step``; blocks double."""
    reached, block = 0, 16
    n = len(codes)
    while True:
        a = start + step * reached
        size = min(block, n - a if step > 0 else a - period + 1)
        if size <= 0:
            return reached
        lo = a if step > 0 else a - size + 1
        unequal = codes[lo:lo + size] != codes[lo - period:lo - period + size]
        if unequal.any():
            return reached + int(np.argmax(unequal if step > 0 else unequal[::-1]))
        reached, block = reached + size, 2 * block


def chained_runs(codes: np.ndarray, least_length: int, least_exponent: int) -> set[tuple[int, int, int]]:
    """Runs ``(start, length, period)`` of one sequence, long enough and of enough periods.

    A run of e periods holds its root e - 1 times in a row; each chain of roots is extended once, from its first.
    """
    found = set()
    n, top, roots = len(codes), int(codes.max()), least_exponent - 1
    place = np.arange(n)
    for ordered in (codes, top - codes):
        length, group = (np.array(x) for x in lyndon_groups(ordered.tolist()))
        first = place[place + roots * length <= n]
        p = length[first]
        same = (first < p) | (group[first - p] != group[first])
        for k in range(1, roots):
            same &= group[first + k * p] == group[first]
        for i, p in zip(first[same].tolist(), p[same].tolist()):
            back = common(codes, p, i + p - 1, -1)
            size = back + roots * p + common(codes, p, i + roots * p, 1)
            if size >= max(least_length, least_exponent * p):
                found.add((i - back, size, p))
    return found


def runs(codes: np.ndarray, least_length: int = LEAST_LENGTH,
         least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """All runs of at least ``max(least_length, least_exponent * period)``, by start and period.

    A word of such a run is met at least that many times in it, so the sequence is cut at words met less often, and
    the pieces again, before they are searched; no run is lost. ``least_exponent`` is a whole number from 2 up.
    """
    found: set[tuple[int, int, int]] = set()
    pieces = [(0, 0, np.asarray(codes))]
    while pieces:
        start, cuts, piece = pieces.pop()
        if len(piece) < least_length:
            continue
        _, piece, counts = np.unique(piece, return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[piece] < least_exponent)
        if len(rare) and cuts < CUTS:
            ends = [*rare.tolist(), len(piece)]
            begins = [0, *(rare + 1).tolist()]
            pieces += [(start + b, cuts + 1, piece[b:e]) for b, e in zip(begins, ends) if e - b >= least_length]
        else:
            found |= {(start + s, size, p) for s, size, p in chained_runs(piece, least_length, least_exponent)}
    return sorted(found, key=lambda r: (r[0], r[2]))


def coded(words: list[bytes]) -> np.ndarray:
    """Words as numbers, in the order of their first use."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words with each run cut to its first period, joined by one space."""
    if found:
        keep = np.ones(len(words), bool)
        for start, size, period in found:
            keep[start + period:start + size] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, edit: Edit | None = None, least_length: int = LEAST_LENGTH,
                  least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """``doc_id``, ``runs`` (start and length in words, period; by start, then period) and ``collapsed`` text.

    Words are what stands between ASCII white space. A null or empty text has no words and no runs. Every row
    gives a row, also repeated ones and those without an id. Of the input only ``doc_id`` and ``text`` are read,
    so other columns cannot clash. Texts are searched whole, whatever their length. ``edit`` may change the
    words before the search.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 256):  # results of few texts are held at once
                every, texts = [], []
                for doc_id, text in zip(ids[at:at + 256], batch.column(1).slice(at, 256)):
                    words = text.as_py().split()  # bytes: splits at ASCII white space only
                    if edit is not None:
                        words = edit(doc_id, words)
                    found = runs(coded(words), least_length, least_exponent)
                    every.append([dict(zip(("start", "length", "period"), r)) for r in found])
                    texts.append(collapsed(words, found).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at:at + 256], pa.int64()), pa.array(every, kind), pa.array(texts, pa.string())],
                    ["doc_id", "runs", "collapsed"])

    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("bigint"), text).mapInArrow(
        search, f"doc_id bigint, runs {RUNS}, collapsed string")


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with each run cut to its first period; white space becomes one space."""
    return periodic_runs(docs).select("doc_id", F.col("collapsed").alias("text"))


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """For one document in ten, by the hash of its id: from some word on, the first words over and over."""
    hashed = zlib.crc32(str(doc_id).encode())
    n, g = len(words), hashed // 10
    if doc_id is None or hashed % 10 or not n:
        return words
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    return words[:start] + [words[start + k % period] for k in range(n - start)]


def greatest(found: Column) -> Column:
    """The run with the greatest exponent, compared as fractions; the first of equal ones. Null without runs."""
    return F.reduce(F.slice(found, 2, F.size(found)), F.get(found, 0), lambda best, run: F.when(
        run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best))


def run_digests(docs: DataFrame) -> DataFrame:
    """Runs of the documents, one in ten with a repeated tail: number, greatest run, and digests of all runs and
    of the collapsed text."""
    best = F.col("best")
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return periodic_runs(docs, repeat_tail).withColumn("best", greatest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(F.lit(1000) * best["length"] / best["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
