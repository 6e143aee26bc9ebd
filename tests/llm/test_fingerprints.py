import hashlib

import xxhash
from pyspark.sql import functions as F

from postloom.llm import fingerprints as fp

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hashes(text):
    w = [x for x in text.translate(LOWER).replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace(
        "\n", " ").replace("\t", " ").split(" ") if x]
    runs = [" ".join(w[k:k + fp.WIDTH]) for k in range(max(1, len(w) - fp.WIDTH + 1))] if w else []
    return {(h - 2 ** 64 if h >= 2 ** 63 else h) for h in (xxhash.xxh64_intdigest(r, 42) for r in runs)}


def sketch(text):
    return sorted(hashes(text))[:fp.K]


def likeness(a, b):
    union = sorted(set(a) | set(b))[:fp.K]
    return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0


def hexed(s):
    return "".join(f"{h % 2 ** 64:016x}" for h in s)


def test_documents(documents):
    rows = sorted((r.doc_id, r.text or "") for r in documents.select("doc_id", "text").collect())
    out = fp.fingerprints(documents).orderBy("doc_id").collect()
    assert [r.doc_id for r in out] == [d for d, _ in rows]
    close = []
    for k, ((_, text), row) in enumerate(zip(rows, out)):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = sketch(text), sketch(changed), sketch(following)
        assert (row.fingerprint, row.edited_fingerprint) == (hexed(a), hexed(b))
        assert abs(row.near_edited - likeness(a, b)) < 1e-12 and abs(row.near_next - likeness(a, c)) < 1e-12
        x, y = hashes(text), hashes(changed)
        close.append(abs(row.near_edited - (len(x & y) / len(x | y) if x | y else 1.0)))
        assert abs(row.n_shingles - len(x)) <= 0.4 * len(x)
    assert sum(close) / len(close) < 0.05


def test_scripts_without_spaces(spark):
    """Texts that differ in their last character are alike, in any script; spaced words are left as they are."""
    han = "今日天气很好我们去公园散步然后回家吃饭睡觉了"
    kana, thai = "きょうはとてもよいてんきですね", "วันนี้อากาศดีมากเราไปเดินเล่น"
    cases = [han, han[:-1] + "吗", kana, kana[:-1] + "よ", thai, thai[:-1] + "ก", "one two three four five", f"a {han} b"]
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")
    got = {r.doc_id: r.sketch for r in fp.with_sketch(rows, F.col("text"), "sketch").collect()}
    assert all(likeness(got[k], got[k + 1]) > 0.8 for k in (0, 2, 4))
    assert likeness(got[0], got[2]) == 0 and len(got[6]) == 1 and 0.6 < likeness(got[0], got[7]) < 1
    assert got[6] == sketch(cases[6]) and got[0] == sketch(" ".join(han))


def test_merge_equals_whole(spark, documents):
    rows = fp.with_sketch(documents.select("doc_id", "text"), F.coalesce("text", F.lit("")), "sketch")
    rows = rows.withColumn("part", F.col("doc_id") % 3)
    whole = {}
    for r in rows.collect():
        whole.setdefault(r.part, set()).update(hashes(r.text or ""))
    for r in fp.merged_by(rows, "part", "sketch").collect():
        assert r.sketch == sorted(whole[r.part])[:fp.K]


def test_blocks_far_apart(spark):
    ids = [-(1 << 40), -3, 0, 1, 4095, 4096, 1 << 24, (1 << 24) + 1, 1 << 40]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id bigint, text string").repartition(4)
    out = {r.doc_id: r.next_text for r in fp.with_next(docs, ["text"]).collect()}
    assert out == {i: f"text {j}" for i, j in zip(ids, ids[1:] + ids[:1])}


def test_edges(edges, nothing):
    out = fp.fingerprints(edges).collect()
    assert len(out) == edges.count()
    assert {r.fingerprint for r in out if r.doc_id in (1, 2, 3)} == {""}
    assert fp.fingerprints(nothing).count() == 0
