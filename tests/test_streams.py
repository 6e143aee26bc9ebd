"""Streams into the ledger: each batch once, whatever fails when."""

import datetime as dt
import json

import pandas as pd
import pytest

from postloom import schemas
from postloom.session import settings
from postloom.sources.landing import Landing
from postloom.sources.ledger import Ledger
from postloom.streaming import incremental, senders
from postloom.streaming.increments import run_increment

T0 = dt.datetime(2026, 7, 14)


@pytest.fixture
def source(spark, tmp_path):
    """A folder of parquet files that grows, and the stream over it."""
    folder = f"{tmp_path}/landed"

    def add(uids, hour=0):
        rows = [("r", "a", u, False, "Ads", "", T0 + dt.timedelta(hours=hour)) for u in uids]
        spark.createDataFrame(rows, schemas.PROCESSED_MESSAGES).coalesce(1).write.mode("append").parquet(folder)

    def stream():
        return spark.readStream.schema(schemas.PROCESSED_MESSAGES).option("maxFilesPerTrigger", 1).parquet(folder)

    return add, stream


def uids(book):
    return sorted(r.uid for r in book.read("processed_messages").collect())


def run(stream, book, path, **options):
    incremental.record_stream(stream(), book, path, **options).awaitTermination()



def test_increments(spark, tmp_path, source):
    add, stream = source
    book = Ledger(spark, f"{tmp_path}/ledger")
    add([1, 2, 2])
    run(stream, book, f"{tmp_path}/c")
    add([2, 3])
    add([3, 4])
    run(stream, book, f"{tmp_path}/c")
    assert uids(book) == [1, 2, 3, 4] and list(book.state().batches.values()) == [2]
    run(stream, book, f"{tmp_path}/other")  # from the start, by another stream
    assert uids(book) == [1, 2, 3, 4] and sorted(book.state().batches.values()) == [2, 2]


def test_failed_batch_is_repeated(spark, tmp_path, source, monkeypatch):
    """A batch that fails before its commit leaves the ledger as it was, and the next query takes it up."""
    add, stream = source
    book = Ledger(spark, f"{tmp_path}/ledger")
    add([1, 2])
    run(stream, book, f"{tmp_path}/c")
    before = book.state()
    add([2, 3])

    def fail(state):
        raise OSError("lost")

    monkeypatch.setattr(book.versions, "commit", fail)
    with pytest.raises(Exception, match="lost"):
        run(stream, book, f"{tmp_path}/c")
    monkeypatch.undo()
    assert book.state() == before
    run(stream, book, f"{tmp_path}/c")
    assert uids(book) == [1, 2, 3] and list(book.state().batches.values()) == [1]


def test_committed_batch_is_not_repeated(spark, tmp_path, source):
    """A query that died behind the ledger's commit and before its own replays the batch: the files stay equal."""
    add, stream = source
    book = Ledger(spark, f"{tmp_path}/ledger")
    add([1, 2])
    add([3])
    run(stream, book, f"{tmp_path}/c")
    before = book.state()
    commits = tmp_path / "c" / "commits"
    for name in ("1", ".1.crc"):
        (commits / name).unlink(missing_ok=True)
    run(stream, book, f"{tmp_path}/c")
    assert book.state() == before and (commits / "1").exists()
    assert json.loads((tmp_path / "c" / "metadata").read_text())["id"] in before.batches


def test_state_expires(spark, tmp_path, source):
    """Keys that come again inside the window are met in state; what is older than the watermark is late."""
    add, stream = source
    book = Ledger(spark, f"{tmp_path}/ledger")
    options = {"max_window": "10 hours"}
    for uids_added, hour in (([1, 2], 0), ([2, 3], 5), ([4], 30), ([5], 1), ([6], 31)):
        add(uids_added, hour)
        run(stream, book, f"{tmp_path}/c", **options)
    assert uids(book) == [1, 2, 3, 4, 6]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != incremental.ROCKSDB[
        "spark.sql.streaming.stateStore.providerClass"]
    state = spark.read.format("statestore").load(f"{tmp_path}/c")
    kept = sorted(r.key.uid for r in state.select("key").collect())
    assert 1 not in kept and 6 in kept


def test_only_files_with_keys_of_the_batch_are_read(spark, tmp_path, source, monkeypatch):
    """New keys open no file of the ledger."""
    add, stream = source
    book = Ledger(spark, f"{tmp_path}/ledger")
    add(range(1000))
    run(stream, book, f"{tmp_path}/c")
    opened = []
    listed = book.versions.files

    def files(folder):
        opened.append(folder)
        return listed(folder)

    monkeypatch.setattr(book.versions, "files", files)
    add(range(10**6, 10**6 + 20))
    run(stream, book, f"{tmp_path}/c")
    assert len([f for f in opened if f.startswith("processed_messages/")]) == 0
    assert len(uids(book)) == 1020


MAIL = "account_label string, uid bigint, from_addr string, internal_date timestamp_ntz"


def test_sender_state(spark, tmp_path):
    """Bursts of closed runs, a run after a gap, late mail, and senders that go idle."""
    folder, out = f"{tmp_path}/mail", f"{tmp_path}/out"
    uid = [0]

    def add(sender, *times):
        rows = []
        for hour in times:
            uid[0] += 1
            rows.append(("a", uid[0], f"{sender}@x.org", T0 + dt.timedelta(hours=hour)))
        spark.createDataFrame(rows, MAIL).coalesce(1).write.mode("append").parquet(folder)

    def go():
        stream = spark.readStream.schema(MAIL).parquet(folder)
        with settings(spark, incremental.ROCKSDB):
            query = senders.sender_bursts(stream, "10 hours").writeStream.format("parquet").option("path", out).option(
                "checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
            query.awaitTermination()
        return sorted((r.sender, (r.run_start - T0).total_seconds() / 3600, r.n, r.prev_n)
                      for r in spark.read.schema(senders.BURST).parquet(out).collect())

    add("ann", 2, 3, 4)       # run 2-8
    add("bob", 2, 9, 10, 11)  # runs 2-8 and 8-14
    add("ann", 9, 10, 11)     # as loud as before: no burst
    assert go() == []         # nothing is closed yet
    add("cid", 30)            # closes all runs up to hour 20
    assert go() == [("ann@x.org", 2, 3, 0), ("bob@x.org", 8, 3, 1)]
    add("ann", 5, 5.5, 7)     # late: its run is closed
    add("ann", 26, 27, 28)    # after a gap, the run before counts 0
    add("cid", 60)
    assert go() == [("ann@x.org", 2, 3, 0), ("ann@x.org", 26, 3, 0), ("bob@x.org", 8, 3, 1)]
    add("cid", 100)
    go()
    left = spark.read.format("statestore").option("stateVarName", "counts").load(f"{tmp_path}/c")
    assert {r.key.sender for r in left.select("key").collect()} == {"cid@x.org"}  # idle senders have no state


def test_sender_state_is_one_value_and_one_timer():
    """The calls to the store for a sender do not grow with its runs; a run that ends at the watermark waits."""
    calls = []

    class Value:
        now = None

        def exists(self):
            return self.now is not None

        def get(self):
            return self.now

        def update(self, value):
            calls.append("update")
            self.now = value

        def clear(self):
            self.now = None

    class Handle:
        timers: set[int] = set()

        def getValueState(self, name, schema):
            return Value()

        def registerTimer(self, at):
            calls.append("timer")
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class At:
        def __init__(self, at):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: at

    state, handle = senders.SenderBursts(), Handle()
    state.init(handle)
    run = senders.RUN_MS
    starts = pd.DataFrame({"run_start_ms": [k * run for k in range(50) for _ in range(k + 1)]})
    list(state.handleInputRows(("ann",), iter([starts]), None))
    assert sorted(calls) == ["timer", "update"] and handle.timers == {run}

    def expire(watermark):
        found = []
        while handle.timers and (first := min(handle.timers)) < watermark:
            handle.timers.remove(first)
            found += [b for b in state.handleExpiredTimer(("ann",), At(watermark), At(first))]
        return [row for b in found for row in zip(b["run_start"].astype("datetime64[ms]").astype("int64") // run, b["n"], b["prev_n"])]

    assert expire(40 * run) == [(k, k + 1, k) for k in range(2, 39)]
    assert len(calls) == 4 and handle.timers == {40 * run}
    assert expire(200 * run) == [(k, k + 1, k) for k in range(39, 50)]
    assert not state.counts.exists() and not handle.timers


def test_increments_drive_runs(spark, tmp_path):
    """Each landed file is read by one run; a failed run leaves nothing and its files come again."""
    book = Ledger(spark, f"{tmp_path}/ledger")
    landing = Landing(spark, f"{tmp_path}/landed", "account_label string, uid bigint, folder string, subject string, "
                      "from_addr string, internal_date timestamp_ntz, date timestamp_ntz, is_read boolean, body string")

    def land(*uids_and_hours):
        rows = [("work", u, "INBOX", f"S{u}", "ann@x.org", T0 + dt.timedelta(hours=h), T0, False, "b")
                for u, h in uids_and_hours]
        landing.write(spark.createDataFrame(rows, landing.schema))

    def provider(prompt):
        import re
        found = re.findall(r"<<< EMAIL (\w+)/(\d+) >>>", prompt)
        return json.dumps({"classifications": [
            {"uid": int(u), "account": a, "label": "Ads", "confidence": 1, "summary": "s", "key_points": ["k"]}
            for a, u in found]})

    def go(hour, use=provider, where="out"):
        done = run_increment(spark, book, landing.stream(), use, f"{tmp_path}/{where}", f"{tmp_path}/c",
                             now=T0 + dt.timedelta(hours=hour), parallelism=1)
        return [sorted(r.uid for r in d.entries.collect()) for d in done]

    land((1, 0), (2, 1), (3, -100))  # the last is older than the cap
    assert go(2) == [[1, 2]] and go(3) == []
    land((4, 3))
    land((5, -20))  # landed late: a lower bound by the last run would miss it
    before = book.state()
    (tmp_path / "file").write_text("")
    with pytest.raises(Exception):
        go(5, where="file/not-a-folder")
    assert book.state() == before
    assert go(6) == [[4, 5]]
    assert uids(book) == [1, 2, 4, 5] and book.runs().where("status = 'completed'").count() == 2
