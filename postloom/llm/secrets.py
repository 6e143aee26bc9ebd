"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Inside a candidate, runs of one character class are read with a window; the fold updates the counts of
the character that enters and the one that leaves, and with them the sum of c * log2(c) that gives the
Shannon entropy. Windows above the threshold of their class join to spans. An allow-list suppresses
candidates that are plainly no secrets. Null text counts as empty: no spans. Positions are code points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import whole

# Kinds in their order for equal starts; the first three are the base patterns.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_upper_hex", "entropy_lower", "entropy_upper")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
# A run of the class matches whole and left to right, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
# Character class, its alphabet, and the entropy in bits that a window must reach: the fewer symbols, the less.
CLASSES = {
    "entropy_hex": (r"[0-9a-f]{20,}", "0123456789abcdef", 3.0),
    "entropy_base64": (r"[A-Za-z0-9+/_=-]{20,}",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.9),
    "entropy_upper_hex": (r"[0-9A-F]{20,}", "0123456789ABCDEF", 3.0),
    "entropy_lower": (r"[a-z0-9]{20,}", "abcdefghijklmnopqrstuvwxyz0123456789", 3.5),
    "entropy_upper": (r"[A-Z0-9]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.5),
}
# Words of one case, ruled lines, paths of words, numbers and dates, UUIDs, and stated examples.
ALLOWED = (r"[A-Z]?[a-z/_=+-]+", r"[A-Z/_=+-]+", r"[0-9TZ:./_+-]+",
           r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
           r".*(?i:example|sample|placeholder|dummy|changeme).*")


# Pieces that words, slugs, paths and identifiers are made of: words of four letters and more, capitalised words, short
# words and constants that stand between separators, the head of a camel-case name, numbers of up to eight digits.
WORDLIKE = (r"[a-z]{4,}+", r"[A-Z][a-z]{2,}+", r"(?<![A-Za-z0-9])[A-Za-z]{1,3}+(?![A-Za-z0-9])",
            r"(?<![A-Za-z0-9])[A-Z]{4,}+(?![A-Za-z0-9])", r"(?<![A-Za-z0-9])[a-z]{1,3}(?=[A-Z][a-z])",
            r"(?<![0-9])[0-9]{1,8}+(?![0-9])", r"[-/_+=]++")


def _span(start: Column, kind: str, end: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                    end.cast("bigint").alias("end"))


_NO_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _none() -> Column:
    return F.array().cast(_NO_SPANS)


def located(text: Column, pattern: str, kind: str, matches: Column, kept=None) -> Column:
    """Spans of the matches of a pattern: the pieces between them give the places.

    ``kept`` says by index which matches count.
    """
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), _none().alias("spans"))

    def step(s: Column, i: Column) -> Column:
        first = s["at"] + F.length(F.get(gaps, i))
        last = first + F.length(F.get(matches, i))
        spans = F.concat(s["spans"], F.array(_span(first, kind, last)))
        return F.struct(last.alias("at"), (spans if kept is None else F.when(kept(i), spans).otherwise(
            s["spans"])).alias("spans"))

    found = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), start, step, lambda s: s["spans"])
    return F.when(F.size(matches) > 0, found).otherwise(_none())


def entropy_spans(run: Column, alphabet: str, threshold: float, window: int = WINDOW) -> Column:
    """Spans (start, end) in a run of one class whose windows reach the threshold; the bounds touch or overlap.

    H = log2(window) - S / window with S the sum of c * log2(c) over the counts c in the window.
    """
    enough = (math.log2(window) - threshold) * window
    empty = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("s"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def weight(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def place(i: Column) -> Column:
        return F.instr(F.lit(alphabet), F.substring(run, i, F.lit(1))) - 1

    def step(state: Column, i: Column) -> Column:
        new, old = place(i), F.when(i > window, place(i - window)).otherwise(F.lit(-1))
        moved = F.array(F.struct(state.alias("t"), new.alias("new"), old.alias("old")))
        return F.get(F.transform(moved, lambda m: update(m["t"], m["new"], m["old"], i)), F.lit(0))

    def update(t: Column, new: Column, old: Column, i: Column) -> Column:
        up, down = F.get(t["counts"], new), F.when(old >= 0, F.get(t["counts"], old))
        change = F.when(new == old, F.lit(0.0)).otherwise(
            weight(up + 1) - weight(up) + F.coalesce(weight(down - 1) - weight(down), F.lit(0.0)))
        counts = F.when(new == old, t["counts"]).otherwise(F.transform(
            t["counts"], lambda c, k: c + (k == new).cast("int") - (k == old).cast("int")))
        s = t["s"] + change
        hit = (i >= window) & (s <= enough + 1e-9)
        last = F.get(t["spans"], F.size(t["spans"]) - 1)
        grow = F.coalesce(last["end"] >= i - window, F.lit(False))
        first = F.when(grow, last["start"]).otherwise(i - window)
        before = F.when(grow, F.slice(t["spans"], 1, F.size(t["spans"]) - 1)).otherwise(t["spans"])
        spans = F.concat(before, F.array(F.struct(first.alias("start"), i.alias("end"))))
        return F.struct(counts.alias("counts"), s.alias("s"), F.when(hit, spans).otherwise(t["spans"]).alias("spans"))

    return F.when(F.length(run) >= window, F.aggregate(
        F.sequence(F.lit(1), F.length(run)), empty, step, lambda s: s["spans"])).otherwise(
            F.array().cast("array<struct<start:int,end:int>>"))


def _shifted(spans: Column, by: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: _span(by + s["start"], kind, by + s["end"]))


def _by_class(kind: str):
    """Function of a candidate (start, string): the spans of one character class."""
    pattern, alphabet, threshold = CLASSES[kind]

    def spans(c: Column) -> Column:
        text = c["string"]
        runs = located(text, pattern, kind, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        return F.flatten(F.transform(runs, lambda r: _shifted(entropy_spans(
            F.substring(text, (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")),
            alphabet, threshold), c["start"] + r["start"], kind)))

    return spans


def scan(docs: DataFrame, allowed: Sequence[str] = ALLOWED, wordlike: Sequence[str] = WORDLIKE) -> DataFrame:
    """One row per document: doc_id, base and all (sorted arrays of start, kind index, end).

    The allow-list suppresses candidates for the entropy windows that match one of ``allowed`` whole, or that
    consist of ``wordlike`` pieces; the base patterns it does not touch. Repeated rows get equal results, a null doc_id
    stays null, and texts are read whole, whatever their length.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text"))
    whole_match, pieces = "^(?:" + "|".join(allowed) + ")$", "|".join(wordlike)
    text = F.col("text")
    rows = rows.withColumns({
        "m_assign": F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(0)),
        "m_access": F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
        "m_hex": F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
        "m_candidate": F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))})
    values = F.when(F.size("m_assign") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)))
    rows = rows.withColumn("values", values)
    rows = rows.withColumns({
        "assign": located(text, ASSIGN, "assign", F.col("m_assign"),
                          lambda i: F.length(F.get(F.col("values"), i)) >= ASSIGN_LEAST),
        "access": located(text, ACCESS, "access", F.col("m_access")),
        "hex": located(text, HEX, "hex", F.col("m_hex")),
        "candidates": F.filter(F.transform(
            located(text, CANDIDATE, "hex", F.col("m_candidate")),
            lambda s, i: F.struct(s["start"].alias("start"), F.get(F.col("m_candidate"), i).alias("string"))),
            lambda c: ~c["string"].rlike(whole_match) & (F.regexp_replace(c["string"], pieces, "") != ""))})
    for kind in CLASSES:
        rows = rows.withColumn(kind, F.when(F.size("candidates") > 0, F.flatten(F.transform(
            "candidates", _by_class(kind)))).otherwise(_none()))
    rows = rows.withColumn("base", F.sort_array(F.concat("assign", "access", "hex")))
    return rows.select("doc_id", "assign", "access", "hex", "base",
                       F.sort_array(F.concat("base", *CLASSES)).alias("all"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs)
    return found.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.col("all")).alias("spans"))
