"""Scheduled runs one after the other, with a source and a classifier of the test's own."""

import datetime as dt
import json
import re

from pyspark.sql import functions as F

from postloom.operators import digest
from postloom.plans.run import run_once
from postloom.sources.ledger import Ledger

T0 = dt.datetime(2026, 7, 14, 8, 0)
SCHEMA = ("account_label string, uid bigint, folder string, subject string, from_addr string, "
          "internal_date timestamp_ntz, date timestamp_ntz, is_read boolean, body string")


def classifier():
    """Made here so that it travels to the workers by value."""

    def answer(prompt):
        if prompt.startswith("The following JSON"):
            return "still wrong"
        found = re.findall(r"<<< EMAIL (\w+)/(\d+) >>>", prompt)
        return json.dumps({"classifications": [
            {"uid": int(uid), "account": account, "label": "Nope" if uid == "13" else "Ads", "confidence": 1,
             "summary": "s", "key_points": ["k"], "priority": "low"} for account, uid in found]})

    return answer


def source(spark, uids, failed=()):
    def when(uid):  # small uids are as many hours old, large ones are new
        return T0 - dt.timedelta(hours=uid) if uid < 100 else T0 + dt.timedelta(hours=1)

    def ingest(since):
        rows = [("work", u, "INBOX", f"S{u}", "ann@x.org", when(u), when(u), False, "b") for u in uids]
        status = [("work", "ok", "")] + [(a, "error", "down") for a in failed]
        return (spark.createDataFrame(rows, SCHEMA),
                spark.createDataFrame(status, "account_label string, status string, error string"))

    return ingest


def test_runs_build_on_each_other(spark, tmp_path):
    book = Ledger(spark, f"{tmp_path}/ledger")
    seen = []

    def go(uids, hour, failed=()):
        now = T0 + dt.timedelta(hours=hour)
        result = run_once(spark, book, source(spark, uids, failed), classifier(), f"{tmp_path}/out",
                          now=now, parallelism=2)
        row = result.statuses.first()
        seen.append(row.run_id)
        return row.status, sorted(r.uid for r in result.entries.collect()), result

    status, uids, result = go([1, 2, 3, 40], 0)  # the first run reads one day back
    assert (status, uids) == ("completed", [1, 2, 3])
    assert "Burst" not in digest.assemble(result.lines).first().payload
    status, uids, result = go([100000, 100001, 100002, 100003], 6, failed=["gone"])
    assert (status, uids) == ("partial", [100000, 100001, 100002, 100003])
    text = digest.assemble(result.lines).first().payload
    assert "- Burst from ann@x.org: 4 messages (was 3)\n- Account failures increased: 1 (was 0)" in text
    assert "- Advertisements up by 1 (was 3, now 4)" in text
    runs = {r.id: r for r in book.runs().collect()}
    assert runs[seen[0]].status == "completed" and runs[seen[0]].message_count == 3


def test_unclear_message_comes_back_next_time(spark, tmp_path):
    book = Ledger(spark, f"{tmp_path}/ledger")
    for _ in range(2):
        result = run_once(spark, book, source(spark, [12, 13]), classifier(), f"{tmp_path}/out",
                          now=T0, window_hours=24, parallelism=1)
        left = sorted(r.uid for r in result.entries.where(F.col("error").isNotNull()).collect())
        assert left == [13]
    assert [r.uid for r in book.read("processed_messages").collect()] == [12]
    statuses = sorted(r.status for r in book.runs().collect())
    assert statuses == ["degraded", "partially_classified"]


def test_released_passes_leave_no_tables(spark, tmp_path):
    import os

    from postloom.session import shared_root
    book = Ledger(spark, f"{tmp_path}/ledger")
    result = run_once(spark, book, source(spark, [1, 2, 3]), classifier(), f"{tmp_path}/out", now=T0,
                      window_hours=24, parallelism=1)
    folder = f"{shared_root(spark).removeprefix('file:')}/staged/{result.staged}"
    assert os.listdir(folder)
    result.release()
    assert not os.path.exists(folder) and book.read("processed_messages").count() == 3


def test_repairs_read_stored_parses(spark, tmp_path, monkeypatch):
    """A filter on parsed columns is pushed below the parse and repeats it for every use, unless the parse is stored."""
    from postloom.operators import prompts
    plans, classify = [], prompts.classify

    def watched(made, *more, **named):
        plans.append(made._jdf.queryExecution().optimizedPlan().toString())
        return classify(made, *more, **named)

    monkeypatch.setattr(prompts, "classify", watched)
    run_once(spark, Ledger(spark, f"{tmp_path}/ledger"), source(spark, [12, 13]), classifier(), f"{tmp_path}/out",
             now=T0, window_hours=24, parallelism=1)
    assert len(plans) == 2 and "from_json" not in plans[1]
