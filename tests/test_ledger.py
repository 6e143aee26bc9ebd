"""The ledger's versions, keyed lookups, merges and transactions."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from postloom import schemas
from postloom.sources import keyed, ledger as store
from postloom.sources.ledger import Ledger
from postloom.sources.versions import ConcurrentWrite, Segment

T0 = dt.datetime(2026, 7, 14)


def processed(spark, start, end, run="r", step=1):
    return spark.range(start, end, step).select(
        F.lit(run).alias("run_id"), F.concat(F.lit("a"), F.col("id") % 3).alias("account_label"), F.col("id").alias("uid"),
        F.lit(True).alias("is_read"), F.lit("Ads").alias("classification"), F.lit("").alias("digest_excerpt"),
        F.lit(T0).cast("timestamp_ntz").alias("processed_at"))


def keys(spark, numbers):
    return spark.createDataFrame([(f"a{n % 3}", n) for n in numbers], "account_label string, uid bigint")


def uids(df):
    return sorted(r.uid for r in df.collect())


def files_below(folder):
    return [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc")]


@pytest.fixture
def small_files(monkeypatch):
    monkeypatch.setattr(keyed, "BLOCK_KEYS", 64)
    monkeypatch.setattr(keyed, "BLOCKS_PER_FILE", 2)


def test_lookup_reads_only_its_files(spark, tmp_path, small_files):
    book = Ledger(spark, str(tmp_path))
    book.record_messages(processed(spark, 0, 4000))
    segment, = book.state().segments("processed_messages")
    assert (segment.rows, segment.blocks, segment.buckets) == (4000, 63, 32)
    found = book.lookup("processed_messages", keys(spark, [5, 5, 9_999_999]))
    assert uids(found) == [5] and len(found.inputFiles()) <= 2 + 1  # one of the data, the staged key
    data = [f for f in found.inputFiles() if "processed_messages" in f]
    assert len(data) == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(account_label" not in plan.split("BroadcastExchange")[0]
    strangers = book.lookup("processed_messages", keys(spark, range(5_000_000, 5_002_000)))
    assert strangers.count() == 0
    everything = book.lookup("processed_messages", keys(spark, range(0, 8000)))
    assert uids(everything) == list(range(4000))


def test_filters_let_few_strangers_pass(spark, tmp_path):
    """The share of unknown keys that their blocks don't rule out; known ones always pass."""
    rows = processed(spark, 0, 20_000)
    names = ["account_label", "uid"]
    count, blocks, files = keyed.write(rows, names, f"{tmp_path}/data", f"{tmp_path}/filters", 20_000)
    assert (count, blocks, files) == (20_000, 10, 1)
    filters = spark.read.parquet(f"{tmp_path}/filters")

    def passing(df):
        return df.select(keyed.block_of(keyed.key_hash(names), F.lit(blocks)).alias("block"),
                         keyed.bits_of(names).alias("at")).join(filters, "block").where(
            F.forall("at", lambda x: keyed.is_set(F.col("bits"), x))).count()

    assert passing(rows) == 20_000
    assert passing(processed(spark, 1_000_000, 1_100_000)) < 1_000


def test_first_writer_wins_across_segments(spark, tmp_path):
    book = Ledger(spark, str(tmp_path))
    book.record_messages(processed(spark, 0, 100, "first"))
    book.record_messages(processed(spark, 50, 150, "second"))
    book.record_messages(processed(spark, 0, 150, "third"))  # nothing new: no segment, no version
    assert {r.run_id: r["count"] for r in book.read("processed_messages").groupBy("run_id").count().collect()} == {
        "first": 100, "second": 50}
    assert book.state().version == 2


def test_many_appends_leave_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "SMALL", 4)
    book = Ledger(spark, str(tmp_path), keep_hours=0)
    rows = spark.createDataFrame([("r", "file", "sent", "h")], schemas.DIGESTS)
    for _ in range(200):
        book.record_digests(rows)
    assert book.read("digests").count() == 200
    assert len(book.state().segments("digests")) < 40
    assert len(files_below(tmp_path)) < 130
    assert sum(s.rows for s in book.state().segments("digests")) == 200


def test_stretches():
    def made(*rows):
        return tuple(Segment(str(k), r) for k, r in enumerate(rows))

    assert store.mergeable(made(*[5] * 7), 8) is None
    assert store.mergeable(made(*[5] * 8), 8) == (0, 8)
    assert store.mergeable(made(10 ** 6, *[5] * 9), 8) == (1, 10)
    assert store.mergeable(made(*[5] * 4, 10 ** 6, *[5] * 4), 8) is None  # a log is merged in its order
    assert store.mergeable(made(10 ** 9, *[5_000] * 6, 10, 20), 8) == (1, 9)


def test_merge_keeps_rows_and_readers(spark, tmp_path):
    book = Ledger(spark, str(tmp_path))
    for k in range(5):
        book.record_messages(processed(spark, 10 * k, 10 * k + 12, f"r{k}"))
    before, old = book.state(), book.read("processed_messages")
    book.compact(least=2)
    assert len(book.state().segments("processed_messages")) == 1
    assert uids(old) == uids(book.read("processed_messages")) == list(range(52))
    assert uids(book.read("processed_messages", book.versions.at(before.version))) == list(range(52))
    assert uids(book.lookup("processed_messages", keys(spark, range(40, 80)))) == list(range(40, 52))
    book.keep_hours = 0
    gone = book.retire()
    assert set(gone) == before.names()
    assert uids(book.read("processed_messages")) == list(range(52))


def test_failed_merge_changes_nothing(spark, tmp_path, monkeypatch):
    book = Ledger(spark, str(tmp_path))
    for k in range(3):
        book.record_messages(processed(spark, 10 * k, 10 * k + 10))
    before = book.state()

    def fail(state):
        raise OSError("no space")

    monkeypatch.setattr(book.versions, "commit", fail)
    with pytest.raises(OSError):
        book.compact(least=2)
    monkeypatch.undo()
    assert book.state() == before and uids(book.read("processed_messages")) == list(range(30))
    book.keep_hours = 0
    assert len(book.retire()) == 1  # what the failed merge had written


def test_merged_logs_and_snapshots(spark, tmp_path):
    now = F.lit(T0).cast("timestamp_ntz")
    book = Ledger(spark, str(tmp_path))
    book.record_runs(spark.createDataFrame([("a", None, ""), ("b", None, "")],
                                           "id string, started_at timestamp_ntz, status string"), now)
    done = spark.createDataFrame([("a", T0, "partial", 3, "early")],
                                 "id string, finished_at timestamp_ntz, status string, message_count bigint, error string")
    book.finish_runs(done)
    book.finish_runs(done.withColumns({"status": F.lit("completed"), "finished_at": F.lit(None).cast("timestamp_ntz")}))
    header = spark.createDataFrame([("a", T0, 0, 1)], "run_id string, finished_at timestamp_ntz, accounts_failed bigint, "
                                                      "high_priority_count bigint")
    for n in (1, 2, 3):
        counts = spark.createDataFrame([("a", "x", n)], "run_id string, label string, n bigint")
        book.save_snapshots(header, counts, counts.withColumnRenamed("label", "sender"),
                            counts.withColumnRenamed("label", "domain"))

    def seen():
        return (sorted(map(tuple, book.runs().collect())), [tuple(r) for r in book.snapshot_headers().collect()],
                [[tuple(r) for r in book.snapshot_counts(k).collect()] for k in ("label", "sender", "domain")])

    before = seen()
    book.compact(least=2)
    assert seen() == before and before[2] == [[("a", "x", 3)]] * 3
    assert book.read("runs").count() == 2 and book.read("run_digest_label_counts").count() == 1
    book.finish_runs(done.withColumn("status", F.lit("degraded")))  # a merged log goes on
    assert {r.id: r.status for r in book.runs().collect()} == {"a": "degraded", "b": "running"}
    with pytest.raises(LookupError):
        book.finish_runs(done.withColumn("id", F.lit("nobody")))


def test_transactions(spark, tmp_path):
    book = Ledger(spark, str(tmp_path))
    rows = spark.createDataFrame([("r", "file", "sent", "h")], schemas.DIGESTS)
    with pytest.raises(ValueError):
        with book.transaction():
            book.record_digests(rows)
            assert book.read("digests").count() == 1  # its own writes are seen inside
            raise ValueError
    assert book.state().version == 0 and book.read("digests").count() == 0
    for _ in range(2):
        with book.transaction("s", 0) as new:
            if new:
                book.record_digests(rows)
                book.record_messages(processed(spark, 0, 5))
    assert book.state().version == 1 and book.state().batches == {"s": 0}
    with book.transaction("s", 1) as new:  # a batch without rows is remembered too
        assert new
    assert book.state().batches == {"s": 1} and book.read("digests").count() == 1


def test_two_writers(spark, tmp_path):
    one, two = Ledger(spark, str(tmp_path)), Ledger(spark, str(tmp_path))
    rows = spark.createDataFrame([("r", "file", "sent", "h")], schemas.DIGESTS)
    with pytest.raises(ConcurrentWrite):
        with one.transaction():
            one.record_digests(rows)
            two.record_digests(rows)
    assert one.read("digests").count() == 1


def test_rows_of_single_keys_are_not_grouped(spark, tmp_path, monkeypatch):
    """Only rows whose key comes twice, or is missing twice, are grouped to find the first; the others stay where they are."""
    grouped, once = [], store.once_per_key

    def watched(new, *more):
        grouped.append(sorted((r.uid or 0, r.run_id) for r in new.collect()))
        return once(new, *more)

    monkeypatch.setattr(store, "once_per_key", watched)
    book = Ledger(spark, str(tmp_path))
    book.record_messages(processed(spark, 0, 50))
    assert grouped == []
    nothing = processed(spark, 0, 1, "n").withColumn("uid", F.lit(None).cast("bigint"))
    twice = processed(spark, 40, 70, "b").unionByName(processed(spark, 60, 63, "a")).unionByName(nothing).unionByName(nothing)
    book.record_messages(twice)
    assert grouped == [sorted([(n, r) for n in (60, 61, 62) for r in "ab"] + [(0, "n")] * 2)]
    stored = {r.uid: r.run_id for r in book.read("processed_messages").collect()}
    assert book.read("processed_messages").count() == 71 and stored[None] == "n" and stored[45] == "r"
    assert [stored[n] for n in (59, 60, 62, 63)] == ["b", "a", "a", "b"]
    files = files_below(f"{tmp_path}/processed_messages")
    assert all(f.endswith(".zstd.parquet") for f in files if "part-" in f)
