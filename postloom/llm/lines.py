"""Line dedup by a segment-partition edit join.

Lines of at least ``LEAST`` code points are compared without white space at their ends; lines within
``THRESHOLD`` edits of each other are linked, and of each class of linked lines the first in order of
(doc_id, text hash, line number) stays. Shorter lines repeat only exact copies; blank lines stay. A line is
cut into threshold-plus-one segments; its own segments, and for each shorter length the substrings where such
a segment could lie, are its keys. Lines that share a key are candidates, verified by banded bit-parallel
edit distance.

Keys and line digests move, texts only for candidates. A key shared by many lines is refined for one edit:
two such lines agree on all but one window, so window keys split it, and within one window all but one
character, where a key makes a star of true links. Pairs of a large group are never listed.

Null text counts as empty and has no lines. A null doc_id comes after all others. Repeated rows share
their decisions; rows of one id with other texts are told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import components, packed, stage, whole

THRESHOLD = 1
LEAST = 20
# Lines sharing a key before its pairs are no longer listed; least width of a window. A window is as wide
# as the root of the length: that makes the fewest keys over windows and the characters in them.
CROWD = 4
WINDOW = 8
# Rows up to which a narrow table read from storage is sent to the other side of a join, and elements of its lists.
# A row has ids, digests and numbers of fixed size, an element three numbers: under 60 MB are sent.
SENT = 200_000
SENT_ELEMENTS = 800_000


def _sent(df: DataFrame, listed: str | None = None) -> DataFrame:
    """``df`` of ids and numbers from storage, broadcast if its rows, and the elements of its list column, are
    few; else joins shuffle both sides."""
    elements = F.sum(F.size(listed)) if listed else F.lit(0)
    rows, many = df.limit(SENT + 1).agg(F.count(F.lit(1)), F.coalesce(elements, F.lit(0))).first()
    return F.broadcast(df) if rows <= SENT and many <= SENT_ELEMENTS else df


def lines(docs: DataFrame, shortest: int = LEAST) -> DataFrame:
    """(doc_id, hash, number, line): the lines of each document from some length on, numbers from 0."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("hash"),
                       F.split(whole(), "\n").alias("lines"))
    rows = rows.select("doc_id", "hash", F.posexplode("lines").alias("number", "line"))
    return rows.withColumn("line", _trimmed(F.col("line"))).where(F.length("line") >= shortest)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def segment(length: Column, number: int, threshold: int) -> tuple[Column, Column]:
    """(start from 1, size) of a segment in a line of some length; later segments take the remainder."""
    parts = threshold + 1
    base, longer = F.floor(length / parts), length % parts
    short = F.greatest(F.lit(0), number - (parts - longer))
    return (number * base + short + 1).cast("int"), (base + F.when(number >= parts - longer, 1).otherwise(0)).cast("int")


def _probes(threshold: int) -> list[tuple[int, int, int]]:
    """(shift, segment, move) of each key: what a line, and lines longer by ``shift``, are looked up by."""
    out = []
    for shift in range(threshold + 1):
        for i in range(threshold + 1):
            low, high = max(-i, shift - (threshold - i)), min(i, shift + (threshold - i))
            out += [(shift, i, move) for move in range(low, high + 1)]
    return out


def keys(line: Column, threshold: int) -> Column:
    """The line's own segments, and the substrings where segments of shorter lines fit, hashed; in the
    order of ``_probes``, null where one does not fit."""
    out, size = [], F.length(line)
    for shift, i, move in _probes(threshold):
        start, width = segment(size - shift, i, threshold)
        key = F.xxhash64(F.lit(i), size - shift, F.substring(line, start + move, width))
        out.append(F.when((start + move >= 1) & (start + move + width - 1 <= size), key))
    return F.array(*out)


def within(a: Column, b: Column, k: int) -> Column:
    """Edit distance of at most ``k`` (up to 14), for texts longer than ``k``, by a banded bit-parallel fold.

    The band holds 32 rows of differences down one column; it moves along the diagonal until its lowest
    row is the end of ``a`` and then along that row. Only matches within ``k`` of the diagonal count.
    """
    top, ones = 31, (1 << 32) - 1
    state = F.struct(F.lit(ones & (ones << (top - k))).cast("bigint").alias("up"), F.lit(0).cast("bigint").alias("down"),
                     F.lit(k).alias("distance"))

    def fold(s: Column, x: Column) -> Column:
        xs, ys, n = s["a"], s["b"], F.size(s["a"])

        def step(t: Column, i: Column) -> Column:
            same = F.lit(0).cast("bigint")
            for d in range(-k, k + 1):
                hit = F.coalesce(F.get(xs, i + d) == F.get(ys, i), F.lit(False))
                same = same + F.when(hit, F.lit(1 << (top - k + d)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
            up, down = t["up"], t["down"]

            def inverse(v: Column) -> Column:
                return F.lit(ones).bitwiseXOR(v)

            def after(m: Column) -> Column:
                zero = m.bitwiseAND(up) + up
                zero = zero.bitwiseAND(F.lit(ones)).bitwiseXOR(up).bitwiseOR(m).bitwiseOR(down)
                return F.get(F.transform(F.array(zero), finish), F.lit(0))

            def finish(zero: Column) -> Column:
                plus = down.bitwiseOR(inverse(zero.bitwiseOR(up)))
                minus = zero.bitwiseAND(up)
                half = F.shiftright(zero, 1)
                slope = i < n - k
                bit = F.greatest(top - 1 - (i - (n - k)), F.lit(0))
                flat = F.getbit(plus, bit).cast("int") - F.getbit(minus, bit).cast("int")
                grow = F.when(slope, 1 - F.getbit(zero, F.lit(top)).cast("int")).otherwise(flat)
                return F.struct(minus.bitwiseOR(inverse(half.bitwiseOR(plus))).alias("up"),
                                half.bitwiseAND(plus).alias("down"), (t["distance"] + grow).alias("distance"))

            return F.get(F.transform(F.array(same), after), F.lit(0))

        return F.aggregate(F.sequence(F.lit(0), F.size(ys) - 1), state, step, lambda t: t["distance"])

    chars = F.array(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b")))
    near = F.get(F.transform(chars, lambda s: fold(s, s)), F.lit(0)) <= k
    return (F.abs(F.length(a) - F.length(b)) <= k) & near


def _pairs(members: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of members of one bucket: two of the bucket's own length, or one and a longer one."""
    own = members.where("own = 1").select(*by, F.col("id").alias("a"))
    rest = members.select(*by, F.col("id").alias("b"), "own")
    pairs = own.join(rest, by).where("own = 0 and a <> b or a < b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _split(members: DataFrame, by: list[str], crowd: int) -> tuple[DataFrame, DataFrame]:
    """(members of buckets up to ``crowd`` lines, members of larger ones); single lines fall out."""
    sizes = stage(members.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("owners")).where(
        "n > 1 and owners > 0").drop("owners"), "buckets")
    shared = members.join(_sent(sizes), by)
    return shared.where(F.col("n") <= crowd).drop("n"), shared.where(F.col("n") > crowd).drop("n")


def _windowed(members: DataFrame) -> DataFrame:
    """Members with a key per window: all of the line but the window."""
    length = F.length("line") - F.col("shift")
    width = F.greatest(F.ceil(F.sqrt(length)), F.lit(WINDOW)).cast("int")
    at = F.explode(F.sequence(F.lit(0), (F.ceil(length / width) - 1).cast("int")))
    rows = members.withColumn("width", width).withColumn("window", at)
    first = F.col("window") * F.col("width")
    size = F.least(F.col("width") + F.col("shift"), F.length("line") - first)
    rows = rows.withColumn("inner", F.substring(F.col("line"), first + 1, size))
    outer = F.xxhash64("window", F.substring(F.col("line"), F.lit(1), first),
                       F.substring(F.col("line"), first + size + 1, F.length("line")))
    return rows.select("key", "id", "shift", "own", outer.alias("outer"), "inner")


def _stars(members: DataFrame) -> DataFrame:
    """Links (a, b) among members of one window bucket: those that share the window but for one character."""
    size = F.length("inner")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.struct(
        F.when(F.col("own") == 1, i).otherwise(F.lit(0)).alias("place"),
        F.concat(F.substring(F.col("inner"), F.lit(1), i - 1), F.substring(F.col("inner"), i + 1, size)).alias("rest")))
    whole_one = F.array(F.struct(F.lit(0).alias("place"), F.col("inner").alias("rest")))
    options = F.when(F.col("own") == 1, F.concat(F.filter(cut, lambda c: size > 0), whole_one)).otherwise(cut)
    rows = members.select("key", "outer", "id", "own", F.explode(options).alias("o"))
    rows = rows.select("id", "own", F.xxhash64("key", "outer", "o.place", "o.rest").alias("star"))
    # At a place, lines of one length differ in one character; any is the middle. At none, a line meets
    # those with one character more; it is the middle, and without it they are not linked.
    middle = rows.groupBy("star").agg(F.min(F.when(F.col("own") == 1, F.col("id"))).alias("a"),
                                      F.count(F.lit(1)).alias("n")).where("n > 1 and a is not null").drop("n")
    return rows.join(middle, "star").where("id <> a").select(
        F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()


def links(distinct: DataFrame, texts, threshold: int = THRESHOLD, crowd: int = CROWD) -> DataFrame:
    """Links ``(a, b)`` that connect every two lines within the threshold.

    ``distinct(id, keys)`` has the lines; ``texts(ids)`` fetches (id, line) for a stored table of ids.
    """
    probes = _probes(threshold)
    shifts = F.array(*[F.lit(shift) for shift, _, _ in probes])
    owns = F.array(*[F.lit(int(shift == 0 and move == 0)) for shift, _, move in probes])
    members = distinct.select("id", F.posexplode("keys").alias("at", "key")).where("key is not null").select(
        "id", "key", F.get(shifts, F.col("at")).alias("shift"), F.get(owns, F.col("at")).alias("own"))
    few, many = _split(members, ["key"], crowd)
    many = stage(many, "crowds")
    pairs = stage(_pairs(few, ["key"]), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(many.select("id"))
    line = texts(stage(ids.distinct(), "candidate-ids"))
    if threshold == 1:
        windowed = stage(_windowed(many.join(line, "id").repartition("id")), "windows")
        few, many = _split(windowed, ["key", "outer"], crowd)
        pairs = pairs.union(_pairs(few, ["key", "outer"])).union(_stars(many))
    else:
        pairs = pairs.union(_pairs(many, ["key"]))
    pairs = stage(pairs.distinct(), "candidates")
    both = pairs.join(line.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(
        line.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    return both.where(within(F.col("x"), F.col("y"), threshold)).select("a", "b")


def decisions(docs: DataFrame, threshold: int = THRESHOLD, crowd: int = CROWD, shortest: int = LEAST) -> DataFrame:
    """Repeated lines: (doc_id, hash, number, first_doc, first_number), the last two naming the line that stays.

    Lines from ``shortest`` up to ``LEAST`` code points have no keys: they meet their exact copies alone.
    """
    found = lines(docs, shortest).withColumn("id", digest(F.col("line")))
    joined = F.when(F.length("line") >= LEAST, keys(F.col("line"), threshold))
    seen = stage(found.select("doc_id", "hash", "number", "id", joined.alias("keys")), "lines")
    distinct = stage(seen.where("keys is not null").select("id", "keys").distinct(), "line-keys")

    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "hash", "number")

    def texts(ids: DataFrame) -> DataFrame:
        """Candidate lines, read where each is first: their documents are found by id, not cut anew."""
        at = seen.join(_sent(ids), "id", "left_semi").groupBy("id").agg(F.min(place).alias("at"))
        at = _sent(stage(at.select("id", F.col("at.doc_id").alias("_id"), F.col("at.hash").alias("_h"), "at.number"), "places"))
        same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_h"))
        line = _trimmed(F.get(F.split("text", "\n"), F.col("number")))
        return stage(docs.select("doc_id", "text").join(at, same).select("id", line.alias("line")).distinct(), "texts")

    roots = stage(components(links(distinct, texts, threshold, crowd)), "classes")
    counts = seen.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    shared = stage(counts.union(roots.select("node")).distinct(), "shared")
    seen = stage(seen.drop("keys").join(_sent(shared), "id"), "repeated")
    per_line = stage(seen.groupBy("id").agg(F.min(place).alias("first")), "firsts")
    linked = per_line.join(_sent(roots.withColumnRenamed("node", "id")), "id")
    firsts = linked.groupBy("root").agg(F.min("first").alias("first"))
    linked = linked.drop("first").join(firsts, "root").select("id", "first")
    alone = per_line.join(_sent(roots.select(F.col("node").alias("id"))), "id", "left_anti")
    classes = stage(linked.union(alone), "line-classes")
    rows = seen.join(_sent(classes), "id")
    return rows.where(~place.eqNullSafe(F.col("first"))).select(
        "doc_id", "hash", "number", F.col("first.doc_id").alias("first_doc"), F.col("first.number").alias("first_number"))


def dropped(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, drop): per document the repeated lines, sorted (number, first_doc, first_number)."""
    rows = decisions(docs, shortest=1).groupBy("doc_id", "hash").agg(F.sort_array(F.collect_set(F.struct(
        "number", "first_doc", "first_number"))).alias("drop"))
    return stage(rows, "dropped")


def without(text: Column, numbers: Column) -> Column:
    """A text without the lines of some numbers."""
    rest = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(numbers, i))
    return F.when(F.size(numbers) > 0, F.array_join(rest, "\n")).otherwise(text)


def _joined(rows: DataFrame, drop: DataFrame) -> DataFrame:
    drop = _sent(drop.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_h"), "drop"), "drop")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_h"))
    out = rows.join(drop, same, "left").drop("_id", "_h")
    return out.withColumn("_numbers", F.coalesce(F.transform("drop", lambda d: d["number"]), F.array().cast("array<int>")))


def line_digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, dropped (line>first document:line, comma-joined),
    text_sha256 of the text that is left."""
    rows = _joined(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), dropped(docs))
    named = F.transform("drop", lambda d: F.concat(
        d["number"].cast("string"), F.lit(">"), F.coalesce(d["first_doc"].cast("string"), F.lit("")), F.lit(":"),
        d["first_number"].cast("string")))
    return rows.select("doc_id", F.size(F.split(whole(), "\n")).cast("bigint").alias("n_lines"),
                       F.size("_numbers").cast("bigint").alias("n_dropped"),
                       F.coalesce(F.array_join(named, ","), F.lit("")).alias("dropped"),
                       F.sha2(without(whole(), F.col("_numbers")), 256).alias("text_sha256"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents without repeated lines; ``n_chars``, where there is one, is that of the new text."""
    rows = _joined(packed(docs), dropped(docs)).withColumn(
        "_text", F.when(F.col("text").isNotNull(), without(F.col("text"), F.col("_numbers"))))
    row = F.col("_row").withField("text", F.col("_text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.size("_numbers") > 0, F.length("_text")).otherwise(
            F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(row.alias("_row")).select("_row.*")
