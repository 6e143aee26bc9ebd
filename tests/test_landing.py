"""The landing table: folders of days, what is pruned, and fetch windows."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from postloom.sources.landing import Landing

T0 = dt.datetime(2026, 7, 1)
SCHEMA = "account_label string, uid bigint, internal_date timestamp_ntz, is_read boolean"


@pytest.fixture(scope="module")
def landing(spark, tmp_path_factory):
    table = Landing(spark, str(tmp_path_factory.mktemp("landing")), SCHEMA)
    rows = [("a", k, T0 + dt.timedelta(hours=k), k % 2 == 0) for k in range(480)] + [("a", 999, None, False)]
    for part in (rows[:200], rows[200:]):
        table.write(spark.createDataFrame(part, SCHEMA))
    return table



def uids(df):
    return sorted(r.uid for r in df.collect())


def scans(df):
    """File scans of the plan that ran, with their metrics."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif hasattr(node, "plan") and node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            out.append((node.toString(), node.metrics().apply("numFiles").value()))
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return out


def test_all_messages_are_kept(landing):
    assert uids(landing.read()) == [*range(480), 999]
    assert landing.read().schema["internal_day"].dataType.simpleString() == "date"


def test_static_pruning(landing):
    since = T0 + dt.timedelta(hours=450, minutes=1)
    df = landing.since(since)
    assert uids(df) == list(range(451, 480)) and "internal_day" not in df.columns
    (plan, files), = scans(df)
    assert re.search(r"PartitionFilters: \[.*internal_day", plan) and "PushedFilters: [IsNotNull(internal_date)" in plan
    everything = landing.read()
    everything.collect()
    assert files == 2 and scans(everything)[0][1] > 20
    assert uids(landing.since(since, unread_only=True)) == list(range(451, 480, 2))


def test_windows_prune_at_run_time(spark, landing):
    def at(h):
        return T0 + dt.timedelta(hours=h)

    windows = spark.createDataFrame([("r", at(20), at(30)), ("s", at(29), at(31)), ("t", at(400), at(400)),
                                     ("none", at(50), at(40)), ("before", at(-50), at(-40))],
                                    "run_id string, since timestamp_ntz, until timestamp_ntz")
    df = landing.windows(windows)
    got = {}
    for r in df.collect():
        got.setdefault(r.run_id, []).append(r.uid)
    assert {k: sorted(v) for k, v in got.items()} == {"r": list(range(20, 31)), "s": [29, 30, 31], "t": [400]}
    (plan, files), = [s for s in scans(df) if "internal_day" in s[0]]
    assert "dynamicpruning" in plan and files <= 4


def test_ingest(landing):
    found, status = landing.ingest()(T0 + dt.timedelta(hours=470))
    assert uids(found) == list(range(470, 480))
    assert [tuple(r) for r in status.collect()] == [("a", "ok", "")]


def test_nothing_landed(spark, tmp_path):
    table = Landing(spark, str(tmp_path), SCHEMA)
    table.write(spark.createDataFrame([], SCHEMA))
    assert table.since(T0).count() == 0 and table.read().columns == [*[c.split()[0] for c in SCHEMA.split(", ")], "internal_day"]
