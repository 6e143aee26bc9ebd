"""Landed mail files: ranges of mboxes, pruning of folders, and the stream."""

import datetime as dt
import gzip
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from postloom.sources import mailbox, mime


def mbox(*mails, eol=b"\n"):
    return b"".join(b"From a@x.org Mon Jul 13 00:00:00 2026" + eol + m + eol + eol for m in mails)


def put(root, account, day, name, data):
    folder = f"{root}/account_label={account}/internal_day={day}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "wb") as f:
        f.write(data)
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


@pytest.mark.parametrize("eol", [b"\n", b"\r\n"])
def test_ranges_share_out_the_messages(monkeypatch, eol):
    """However a file is cut, every message is read once and whole."""
    rng = random.Random(4)
    monkeypatch.setattr(mailbox, "BLOCK", 37)
    mails = []
    for k in range(25):
        lines = [b"Subject: %d" % k] + [rng.choice([b"", b"text", b">From me", b"From", b"xFrom y"]) for _ in range(rng.randrange(8))]
        mails.append(eol.join([*lines, b"end"]))
    data = mbox(*mails, eol=eol)
    want = [m.replace(b">From", b"From") for m in mails]
    for size in [*range(1, 40), 200, 10_000]:
        got = [m for at in range(0, len(data), size)
               for m in mailbox.mbox_messages(io.BytesIO(data), at, min(at + size, len(data)))]
        assert [m for _, m in got] == [w + eol for w in want], size
        assert all(data[p:].startswith(b"From a@x.org") for p, _ in got)


def test_odd_files():
    def read(data):
        return [m for _, m in mailbox.mbox_messages(io.BytesIO(data), 0, len(data))]

    assert read(b"") == [] and read(b"no mbox at all\n") == []
    assert read(b"From x\nSubject: a\n\nFrom the start of a line\n") == [b"Subject: a\n", b""]
    assert read(b"From x\nbody\nFrom not a border\n") == [b"body\nFrom not a border\n"]


@pytest.fixture
def root(spark, tmp_path):
    mailbox.register(spark)
    mail = "Subject: {0}\r\nContent-Type: text/plain\r\n\r\nbody {0}\r\n"
    put(tmp_path, "work", "2026-07-13", "1.eml", mail.format("w1").encode())
    put(tmp_path, "work", "2026-07-13", "box", mbox(*[mail.format(f"b{k}").encode() for k in range(40)]))
    put(tmp_path, "work", "2026-07-14", "2.eml", mail.format("w2").encode())
    put(tmp_path, "home%20s", "2026-07-14", "3.eml", mail.format("h1").encode())
    put(tmp_path, "home%20s", "2026-07-15", "_note", b"hidden")
    os.makedirs(f"{tmp_path}/account_label=x/other")
    return str(tmp_path)


def subjects(df):
    found = df.select(F.regexp_extract(F.col("raw").cast("string"), r"Subject: (\w+)", 1).alias("s"))
    return sorted(r.s for r in found.collect())


def test_batch(spark, root):
    df = spark.read.format("mailbox").load(root)
    boxed = [f"b{k}" for k in range(40)]
    assert subjects(df) == sorted([*boxed, "w1", "w2", "h1"])
    cut = spark.read.format("mailbox").option("splitBytes", 300).load(root)
    assert subjects(cut) == sorted([*boxed, "w1", "w2", "h1"]) and cut.rdd.getNumPartitions() > 8
    assert {(r.account_label, r.internal_day) for r in df.select("account_label", "internal_day").collect()} == {
        ("work", dt.date(2026, 7, 13)), ("work", dt.date(2026, 7, 14)), ("home s", dt.date(2026, 7, 14))}
    decoded = mime.bodies_and_attachments(mime.message_leaves(df.where("account_label = 'home s'")))
    assert [r.body for r in decoded.collect()] == ["body h1"]


def test_folders_are_pruned(spark, root):
    df = spark.read.format("mailbox").load(root)
    day = df.where("internal_day >= date'2026-07-14' and account_label = 'work'")
    assert subjects(day) == ["w2"] and day.rdd.getNumPartitions() == 1
    assert subjects(df.where("account_label in ('home s', 'nobody')")) == ["h1"]
    assert subjects(df.where("position > 100000000")) == []


def test_stream_reads_each_file_once(spark, root, tmp_path):
    def go():
        query = (spark.readStream.format("mailbox").load(root).writeStream.format("parquet")
                 .option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        return subjects(spark.read.schema(mailbox.SCHEMA).parquet(f"{tmp_path}/out"))

    assert len(go()) == 43
    put(root, "work", "2026-07-16", "9.eml", b"Subject: late\r\n\r\nx")
    assert len(go()) == 44 and "late" in go()


def test_packed_mail(spark, tmp_path):
    """Mail is written packed, in files of few messages; every message comes back whole, also from files of other sizes."""
    mailbox.register(spark)
    text = "Subject: {0}\r\n\r\nFrom the start\r\n>From\r\n\r\nFrom x\r\n" + "body {0} " * 200
    rows = [("work" if k % 3 else "a b", dt.date(2026, 7, 13 + k % 2), text.format(k).encode() if k != 7 else None) for k in range(50)]
    mail = spark.createDataFrame(rows, "account_label string, internal_day date, raw binary").coalesce(1)
    mailbox.write(mail, f"{tmp_path}/box", 5)
    files = [f"{d}/{f}" for d, _, names in os.walk(f"{tmp_path}/box") for f in names if f.startswith("part-")]
    assert len(files) >= 10 and all(f.endswith(".gz") for f in files)
    assert sum(map(os.path.getsize, files)) < sum(len(r[2] or b"") for r in rows) / 4
    read = spark.read.format("mailbox").option("splitBytes", 100).load(f"{tmp_path}/box")
    got = sorted((r.account_label, r.internal_day, bytes(r.raw)) for r in read.collect())
    assert got == sorted((a, d, m + b"\r\n") for a, d, m in rows if m is not None)


def test_packed_files_beside_plain_ones(spark, tmp_path):
    mailbox.register(spark)
    mails = [b"Subject: %d\n\n" % k + b"x" * 5000 for k in range(9)]
    put(tmp_path, "w", "2026-07-13", "box", mbox(*mails[:3]))
    put(tmp_path, "w", "2026-07-13", "box.gz", gzip.compress(mbox(*mails[3:5])) + gzip.compress(mbox(*mails[5:8])))
    put(tmp_path, "w", "2026-07-13", "1.eml.gz", gzip.compress(mails[8] + b"\n"))
    read = spark.read.format("mailbox").option("splitBytes", 64).load(str(tmp_path))
    assert sorted(bytes(r.raw) for r in read.collect()) == sorted(m + b"\n" for m in mails)
    assert sorted(r.position for r in read.where("file like '%box.gz'").collect()) == [
        sum(len(mbox(m)) for m in mails[3:k]) for k in range(3, 8)]
