"""Operators on small tables: windows, skew helpers, digests, ledger, streams, and the whole pass."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from postloom.functions import dates
from postloom.operators import asof, digest, highlights, messages, prompts, ranking, skew, stats
from postloom.params import DigestOptions, TriageOptions
from postloom.plans import triage as plan
from postloom.sources.ledger import Ledger
from postloom.streaming import incremental

T0 = dt.datetime(2026, 7, 14, 10, 0)


def hours(n):
    return T0 + dt.timedelta(hours=n)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("last, explicit, cap, expected", [
    (None, None, 72, hours(-24)), (hours(-5), None, 72, hours(-5)), (hours(-100), None, 72, hours(-72)),
    (hours(-100), None, 0, hours(-72)), (hours(-5), None, 2, hours(-2)), (hours(-5), 200, 72, hours(-200)),
])
def test_fetch_window(spark, last, explicit, cap, expected):
    df = spark.createDataFrame([(T0, last)], "now timestamp_ntz, last timestamp_ntz")
    assert df.select(dates.fetch_since(F.col("now"), F.col("last"), explicit, cap)).first()[0] == expected


def test_previous_run_is_strictly_earlier_and_completed(spark):
    runs = spark.createDataFrame([
        ("a", hours(0), "completed"), ("b", hours(1), "degraded"), ("c", hours(2), "completed"),
        ("d", hours(2), "partial"), ("e", hours(60), "completed"), ("f", hours(61), "completed"),
        ("g", None, "running"), ("h", hours(200), "completed")],
        "id string, finished_at timestamp_ntz, status string")
    snaps = runs.where("id <> 'f'").select(F.col("id").alias("run_id"))
    found = asof.previous_runs(runs, snaps, F.lit(hours(62)).cast("timestamp_ntz"))
    assert rows(found.fillna("-"), "run_id", "prev_run_id") == [
        ("a", "-"), ("b", "a"), ("c", "a"), ("d", "a"), ("e", "c"), ("f", "e"), ("g", "e"), ("h", "e")]


def test_split_row_number_equals_a_plain_window(spark):
    # one hot group holds most rows and spans many blocks
    df = spark.range(20000).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise((F.col("id") % 3).cast("string")).alias("g"),
        F.col("id").alias("uid"), (F.col("id") % 11).alias("x"))
    from pyspark.sql import Window
    got = skew.split_row_number(
        df, ["g"], [[(F.col("x"), False)], [(skew.uid_block(F.col("uid"), 8), True)]],
        [F.desc("x"), F.asc("uid")], "n")
    want = df.withColumn("m", F.row_number().over(
        Window.partitionBy("g").orderBy(F.desc("x"), F.asc("uid"))))
    joined = got.join(want, ["g", "uid", "x"])
    assert joined.count() == 20000 and joined.where("n <> m").count() == 0
    ranged = skew.ranged_row_number(df, ["g"], [F.desc("x"), F.asc("uid")], "n")
    joined = ranged.join(want, ["g", "uid", "x"])
    assert ranged.columns == [*df.columns, "n"]
    assert joined.count() == 20000 and joined.where("n <> m").count() == 0


def test_ranged_row_number_keeps_null_groups_and_splits_one_second(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.lit("g")).alias("g"), F.lit(T0).alias("date"),
                                  F.col("id").alias("uid"))
    spread = skew.ranged_row_number(df.repartition(8), ["g"], [F.desc("date"), F.asc("uid")], "n")
    for group, n in ((None, 2000), ("g", 4000)):
        own = spread.where(F.col("g").eqNullSafe(F.lit(group))).orderBy("uid").collect()
        assert [r.n for r in own] == list(range(1, n + 1))
    assert skew.ranged_row_number(df.limit(0), ["g"], [F.asc("uid")], "n").count() == 0


def test_fetch_batches(spark):
    df = spark.createDataFrame([("a", "INBOX", u) for u in (5, 70000, 9, 200001, 7)] + [("b", "INBOX", 1)],
                               "account_label string, folder string, uid bigint")
    assert rows(ranking.fetch_batches(df, 2), "account_label", "uid", "batch") == [
        ("a", 5, 0), ("a", 7, 0), ("a", 9, 1), ("a", 70000, 1), ("a", 200001, 2), ("b", 1, 0)]
    assert {r.batch for r in ranking.fetch_batches(df, 0).collect()} == {0}


def test_top_n_ties_by_key(spark):
    df = spark.createDataFrame([("r", k, n) for k, n in [("b", 3), ("a", 3), ("c", 5), ("d", 1)]],
                               "run_id string, sender string, n bigint")
    assert stats.top_lists(df, ["run_id"], "sender", "top", 3).first().top == ["c (5)", "a (3)", "b (3)"]


def test_failed_account_loses_all_rows(spark):
    m = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("s", "a", 3)],
                              "run_id string, account_label string, uid bigint")
    s = spark.createDataFrame([("r", "a", "error", "x"), ("r", "b", "ok", ""), ("s", "a", "ok", "")],
                              "run_id string, account_label string, status string, error string")
    assert rows(messages.drop_failed_accounts(m, s), "run_id", "uid") == [("r", 2), ("s", 3)]


@pytest.mark.parametrize("facts, status", [
    (dict(errors=1, fetched_raw=0), "ingest_failed"), (dict(fetched_raw=5), "completed"),
    (dict(fetched_raw=5, errors=1), "completed"), (dict(), "completed"),
    (dict(fetched=3, classified=3), "completed"), (dict(fetched=3, classified=3, errors=1), "partial"),
    (dict(fetched=3, classified=2, analysis_failed=1, errors=1), "partially_classified"),
    (dict(fetched=3), "degraded"), (dict(fetched=3, classified=3, classify_failed=True), "degraded"),
    (dict(fetched=3, classified=3, delivery_failed=True, errors=1), "degraded"),
])
def test_run_status(spark, facts, status):
    base = dict(errors=0, fetched_raw=0, fetched=0, classified=0, analysis_failed=0,
                classify_failed=False, delivery_failed=False)
    base.update({"fetched_raw": facts.get("fetched", 0), **facts})
    df = spark.createDataFrame([tuple(base.values())], ", ".join(
        f"{k} {'boolean' if isinstance(v, bool) else 'bigint'}" for k, v in base.items()))
    assert plan.run_status(df).first().status == status


MESSAGES = ("run_id string, account_label string, uid bigint, folder string, subject string, from_addr string, "
            "internal_date timestamp_ntz, date timestamp_ntz, is_read boolean, body string")


def sample(spark):
    def row(account, uid, sender, read=False, hour=0):
        return ("r1", account, uid, "INBOX", f"S{uid}", sender, hours(hour), hours(hour), read, "b" * 600)

    return spark.createDataFrame([
        row("work", 1, "Ann <ann@x.org>", True), row("work", 2, "ann@x.org", hour=1),
        row("work", 3, "ann@x.org", hour=2), row("home", 4, "bob@Y.org", hour=3),
        row("gone", 5, "zoe@z.org")], MESSAGES)


def item(account, uid, label, priority, confidence=0.5):
    return {"uid": uid, "account": account, "label": label, "confidence": confidence, "reason": f"r{uid}",
            "summary": f"s{uid}", "key_points": [f"k{i}" for i in range(7)], "action_items": ["a"],
            "priority": priority}


def run_pass(spark, options=TriageOptions(), answer=None, ledger_rows=(), **more):
    m = sample(spark)
    status = spark.createDataFrame([
        ("r1", "work", "ok", ""), ("r1", "home", "ok", ""), ("r1", "gone", "error", "e" * 90),
        ("r1", "idle", "ok", "")], "run_id string, account_label string, status string, error string")
    reply = answer or json.dumps({"schema_version": 1, "classifications": [
        item("work", 1, "Useful", "low"), item("work", 2, "Ads", "high"),
        item("work", 3, "Nope", "low"), item("home", 4, "Ads", "medium"), item("who", 9, "Ads", "high")]})
    requests = m.select("run_id", F.lit("b").alias("batch_id"), "account_label", "uid")
    answers = spark.createDataFrame([("r1", "b", 0, reply, None)], (
        "run_id string, batch_id string, attempt int, raw string, reply_error string"))
    runs = spark.createDataFrame([("r0", hours(-6), "completed"), ("r1", None, "running")],
                                 "id string, finished_at timestamp_ntz, status string")
    ledger = spark.createDataFrame(list(ledger_rows), "account_label string, uid bigint")
    header = spark.createDataFrame([("r0", 0)], "run_id string, accounts_failed bigint")
    labels = spark.createDataFrame([("r0", "Ads", 1)], "run_id string, label string, n bigint")
    senders = spark.createDataFrame([("r0", "ann@x.org", 2)], "run_id string, sender string, n bigint")
    return plan.triage(m, requests, answers, status, runs, ledger, header, labels, senders, options,
                       now=F.lit(hours(6)).cast("timestamp_ntz"), **more)


def payload(result, run="r1"):
    return digest.assemble(result.lines).where(F.col("run_id") == run).first().payload


def test_whole_pass(spark, tmp_path):
    result = run_pass(spark)
    totals = result.totals.first()
    assert (totals.fetched, totals.classified, totals.failed, totals.unrequested) == (4, 4, 1, 1)
    assert (totals.accounts_checked, totals.accounts_failed, totals.accounts_succeeded) == (4, 1, 3)
    assert (totals.read, totals.unread, totals.high_priority, totals.analysis_failed) == (1, 3, 1, 1)
    assert {r.id if "id" in r else r.run_id: r.status for r in result.statuses.collect()}["r1"] == (
        "partially_classified")
    assert rows(result.flag_plan, "account_label", "uid", "keyword") == [
        ("home", 4, "Ads"), ("who", 9, "Ads"), ("work", 1, "Useful"), ("work", 2, "Ads")]
    text = payload(result)
    assert text.startswith(
        "# 📧 Email Digest\n\n**Run ID:** r1\n**Generated:** 2026-07-14 16:00\n## Highlights\n"
        "- 1 high-priority email require attention\n"
        '- Account "gone" failed: ' + "e" * 77 + "...\n"
        "- Advertisements up by 1 (was 1, now 2)\n"
        "- Burst from ann@x.org: 3 messages (was 2)\n"
        "- Account failures increased: 1 (was 0)\n"
        "## Summary\n\n**Fetched:** 4\n**Classified:** 4\n**Failed:** 1\n"
        "**Accounts:** 4 checked, 3 succeeded, 1 failed\n**High priority:** 1\n**Read:** 1\n**Unread:** 3\n"
        "**Labels:** Ads=2 Unknown=1 Useful=1\n**Top senders:**\n- ann@x.org (3)\n- bob@Y.org (1)\n"
        "**Noisiest domains:**\n- x.org (3)\n- y.org (1)\n**Messages:** 4 classified (4 fetched, 1 failed)\n"
        "## Account Stats\n### gone\n\n**Fetched:** 0 | **Classified:** 0 | **Failed:** 0\n"
        "**Read:** 0 | **Unread:** 0\n**Labels:**\n⚠️ **Fetch error:** " + "e" * 90 + "\n### home\n")
    assert ("## 🚨 Needs Attention\n### 1. S2\n\n**From:** ann@x.org | **Date:** 2026-07-14 11:00\n"
            "**Status:** 🆕 Unread\n**Priority:** 🔴 High\n**Reason:** r2\n---\n\n## Ads (2)\n### 1. S2\n") in text
    assert ("**Confidence:** 50%\n**Reason:** r2\n**Summary:** s2\n\n**Key points:**\n- k0\n- k1\n- k2\n- k3\n"
            "- k4\n\n**Action items:**\n- a\n### 2. S4\n") in text
    assert "⚠️ **Analysis failed (repair):** repair failed: no reply\n> " + "b" * 500 + "…\n" in text
    assert text.endswith("\n\n---\n\n*Generated by postloom*\n")

    book = Ledger(spark, f"{tmp_path}/ledger")
    at = F.lit(hours(7)).cast("timestamp_ntz")
    book.record_runs(spark.createDataFrame([("r0", hours(-6), ""), ("r1", hours(0), "")],
                                           "id string, started_at timestamp_ntz, status string"), at)
    assert plan.record(result, book, f"{tmp_path}/out", at, TriageOptions(dry_run=True)) == []
    assert book.read("processed_messages").count() == 0
    for _ in range(2):  # repeating the sinks changes nothing but the delivery log
        plan.record(result, book, f"{tmp_path}/out", at)
    assert rows(book.read("processed_messages"), "account_label", "uid", "classification") == [
        ("home", 4, "Ads"), ("work", 1, "Useful"), ("work", 2, "Ads")]
    assert book.read("flags_applied").count() == 4
    assert rows(book.snapshot_counts("label"), "label", "n") == [("Ads", 2), ("Unknown", 1), ("Useful", 1)]
    assert book.runs().where("id = 'r1'").first().status == "partially_classified"
    files = spark.read.text(f"{tmp_path}/out/run_id=r1")
    assert "\n".join(r.value for r in files.collect()).count("### ") == text.count("### ")
    with pytest.raises(LookupError):
        book.finish_runs(spark.createDataFrame([("nope", hours(0), "completed", 0, "")], (
            "id string, finished_at timestamp_ntz, status string, message_count bigint, error string")))


def pass_by_reference(spark, monkeypatch):
    """The sample's pass, its texts by reference: one twice, one null, one unknown; a key is fetched twice, one has no uid."""
    m = sample(spark).drop("body").withColumn("body_ref", F.when(F.col("uid") != 3, F.col("uid")))
    m = m.unionByName(m.where("uid = 2")).unionByName(m.where("uid = 1").withColumn("uid", F.lit(None).cast("bigint")))
    texts = spark.createDataFrame([(1, "a" * 600), (2, "b"), (2, "c"), (4, None), (8, "d")], "body_ref bigint, body string")
    monkeypatch.setitem(globals(), "sample", lambda _: m)
    return m, texts


def test_texts_by_reference_give_the_same_pass(spark, monkeypatch):
    m, texts = pass_by_reference(spark, monkeypatch)
    names = ("account_label", "uid", "label", "classified", "error", "excerpt")

    def found(result):
        return sorted(map(repr, result.entries.select(*names).collect())), payload(result), sorted(
            map(repr, result.totals.collect()))

    got = found(run_pass(spark, texts=texts))
    by_body = m.join(texts, "body_ref", "left").drop("body_ref")
    monkeypatch.setitem(globals(), "sample", lambda _: by_body)
    assert got == found(run_pass(spark))
    assert len(got[0]) == 8 and sum("a…" in r for r in got[0]) == 2


@pytest.mark.parametrize("by_reference", [True, False])
def test_a_pass_selects_and_ranks_rows_without_texts(spark, monkeypatch, by_reference):
    more = {"texts": pass_by_reference(spark, monkeypatch)[1]} if by_reference else {}
    selected, ranked = [], []
    select, stage = plan.select_messages, ranking.stage
    monkeypatch.setattr(plan, "select_messages", lambda df, *a: selected.append(df.columns) or select(df, *a))
    monkeypatch.setattr(ranking, "stage", lambda df, name: ranked.append(df) or stage(df, name))
    run_pass(spark, **more)
    assert len(selected) == 1 and not {"body", "excerpt"} & set(selected[0])
    assert [df.columns for df in ranked] == [[ranking.ENTRY_ID]] * 2
    for df in ranked:
        assert "excerpt" not in df._jdf.queryExecution().executedPlan().toString()


def test_rows_with_an_id_are_capped_as_others(spark):
    df = spark.range(60).select(
        F.when(F.col("id") % 4 > 0, (F.col("id") % 2).cast("string")).alias("run_id"), F.lit("a").alias("account_label"),
        F.when(F.col("id") % 9 > 0, F.col("id")).alias("uid"), F.lit(T0).alias("date"),
        F.when(F.col("id") % 5 > 0, F.lit("High")).alias("priority"), F.col("id").alias("text"))
    for cap in (ranking.most_important, ranking.first_fetched):
        for limit in (0, 11):
            got = cap(df.withColumn(ranking.ENTRY_ID, F.col("text") + 7), limit)
            assert rows(got, "text") == rows(cap(df, limit), "text")


def test_fallback_digest_when_nothing_is_valid(spark):
    result = run_pass(spark, answer="sorry")
    text = payload(result)
    assert text.startswith("# ⚠️ Email Digest (Fallback)\n\n**Run ID:** r1\n**Generated:** 2026-07-14 16:00\n"
                           "**Status:** ⚠️ LLM classification was unavailable — messages are listed without "
                           "labels.\n\n---\n## Summary\n\n**Fetched:** 4\n**Classified:** 0\n**Failed:** 4\n")
    assert ("\n\n---\n\n## Fetched Messages (4)\n### 1. S4\n\n**From:** bob@Y.org | **Date:** 2026-07-14 13:00\n"
            "**Status:** 🆕 Unread\n\n> " + "b" * 500 + "…\n### 2. S1\n") in text
    assert text.endswith("\n\n---\n\n*Generated by postloom (fallback mode)*\n")
    assert {r.run_id: r.status for r in result.statuses.collect()}["r1"] == "degraded"


def test_switches(spark):
    off = DigestOptions(include_read_status=False, include_global_stats=False, include_account_stats=False,
                        include_summaries=False, priority_only=True, max_messages=1)
    text = payload(run_pass(spark, TriageOptions(digest=off)))
    assert "Status:" not in text and "## Summary" not in text and "Account Stats" not in text
    assert "## Ads (1)" in text and "## Useful" not in text and "Summary:" not in text
    no_raw = DigestOptions(include_raw_excerpt_fallback=False, include_action_items=False, max_messages=0)
    text = payload(run_pass(spark, TriageOptions(digest=no_raw)))
    assert "> [Raw excerpt omitted — enable include_raw_excerpt_fallback to view]" in text
    assert "Action items" not in text and "### 2. S4" in text
    with pytest.raises(ValueError):
        DigestOptions(max_messages=-1)


def test_ledger_and_force(spark):
    done = [("work", 1), ("work", 2), ("work", 3), ("home", 4)]
    result = run_pass(spark, ledger_rows=done)
    assert result.entries.count() == 0
    assert {r.run_id: r.status for r in result.statuses.collect()}["r1"] == "completed"

    def own_renderer(runs, totals, accounts, entries, highlights, options):
        return totals.select("run_id", F.lit(0).alias("section"), F.lit("").alias("grp"),
                             F.lit(0).cast("bigint").alias("item"), F.lit("").alias("key"),
                             F.lit(0).alias("line"), F.concat(
                                 F.col("fetched").cast("string"), F.lit(" mails")).alias("text"))

    forced = run_pass(spark, TriageOptions(force_reprocess=True), ledger_rows=done,
                      renderer=own_renderer)
    assert forced.entries.count() == 4
    assert payload(forced) == "4 mails"


def test_quiet_run_says_so(spark):
    runs = spark.createDataFrame([("a",), ("b",)], "run_id string")
    told = spark.createDataFrame([("b", 4, -3, "s", "Burst")],
                                 "run_id string, kind int, weight bigint, key string, text string")
    got = digest.assemble(digest.highlight_lines(runs, told))
    assert rows(got, "run_id", "payload") == [
        ("a", "## Highlights\n— Nothing notable this run."), ("b", "## Highlights\n- Burst")]


def test_a_long_digest_is_whole(spark):
    """No size turns a digest into a failed one."""
    lines = spark.range(70).select(
        F.lit("r").alias("run_id"), F.lit(5).alias("section"), F.lit("g").alias("grp"), F.col("id").alias("item"),
        F.lit("").alias("key"), F.lit(0).alias("line"), F.repeat(F.lit("x"), 1 << 20).alias("text"))
    row = digest.assemble(lines).select("bytes", F.length("payload").alias("n"), "payload_hash").first()
    assert row.bytes == 70 * (1 << 20) + 69 == row.n and row.payload_hash


def test_prompt_never_reads_placeholders_in_mail(spark):
    m = sample(spark).withColumn("body", F.lit("{labels} {messages} {{x}}"))
    made = prompts.build_prompts(prompts.request_batches(m, 2), ["L"], "<{labels}>{messages}!")
    got = {r.batch_id: r.prompt for r in made.collect()}
    assert set(got) == {"work/0", "work/1", "home/0", "gone/0"}
    assert got["home/0"].startswith("<- L>\n<<< EMAIL home/4 >>>\nFrom: bob@Y.org\nSubject: S4\n"
                                    "Date: Tue, 14 Jul 2026 13:00:00 +0000\nStatus: Unread\n\nBody:\n"
                                    "{labels} {messages} {{x}}\n<<< END EMAIL home/4 >>>\n!")


def test_failing_classifier_is_data(spark):
    made = prompts.build_prompts(prompts.request_batches(sample(spark)))

    def provider(text):
        if "home/4" in text:
            raise RuntimeError("quota")
        return "{}"

    got = {r.batch_id: (r.raw, r.reply_error) for r in prompts.classify(made, provider).collect()}
    assert got["home/0"] == (None, "quota") and got["work/0"] == ("{}", None)


def test_stream_drops_late_rows_and_repeats(spark, tmp_path):
    schema = "account_label string, uid bigint, internal_date timestamp_ntz"
    source = f"{tmp_path}/in"

    def land(*values):
        spark.createDataFrame(list(values), schema).coalesce(1).write.mode("append").json(source)

    def run():
        stream = spark.readStream.schema(schema).json(source)
        (incremental.distinct_messages(stream).writeStream.format("json").option("path", f"{tmp_path}/out")
         .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination())
        return sorted(r.uid for r in spark.read.schema(schema).json(f"{tmp_path}/out").collect())

    land(("a", 1, hours(0)), ("a", 1, hours(0)), ("a", 2, hours(1)))
    assert run() == [1, 2]
    land(("a", 1, hours(0)), ("a", 3, hours(200)))
    assert run() == [1, 2, 3]
    land(("a", 4, hours(0)), ("a", 5, hours(201)))  # uid 4 is older than the look-back cap
    assert run() == [1, 2, 3, 5]


def test_run_windows_start_at_two(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 7, 14, 9), "A"), (dt.datetime(2026, 7, 14, 1), "A")],
                               "internal_date timestamp_ntz, label string")
    assert rows(incremental.run_counts(df, "label"), "run_start", "n") == [
        (dt.datetime(2026, 7, 13, 20), 1), (dt.datetime(2026, 7, 14, 8), 1)]


def test_only_loud_and_louder_senders_burst(spark):
    def at(hour, n, who):
        return [(dt.datetime(2026, 7, 14) + dt.timedelta(hours=hour), who)] * n

    df = spark.createDataFrame(at(3, 2, "a@x") + at(9, 3, "a@x") + at(15, 3, "a@x") + at(9, 2, "b@x")
                               + at(3, 4, "c@x") + at(15, 5, "c@x"),
                               "internal_date timestamp_ntz, from_addr string")
    got = [(r.sender, r.run_start.hour, r.n, r.prev_n) for r in incremental.bursts(df).collect()]
    assert sorted(got) == [("a@x", 8, 3, 2), ("c@x", 2, 4, 0), ("c@x", 14, 5, 0)]


def test_ads_highlight_needs_a_predecessor_with_ads(spark):
    labels = spark.createDataFrame([("b", "Ads", 3), ("c", "Ads", 3)], "run_id string, label string, n bigint")
    prev = spark.createDataFrame([("b", "a"), ("c", None)], "run_id string, prev_run_id string")
    none = labels.limit(0)
    assert highlights.ads_increase(labels, prev, none).count() == 0
    snap = spark.createDataFrame([("a", "Ads", 1)], "run_id string, label string, n bigint")
    assert [r.text for r in highlights.ads_increase(labels, prev, snap).collect()] == [
        "Advertisements up by 2 (was 1, now 3)"]


def test_missing_header_fields_leave_their_lines(spark):
    """Null subject, sender and date: empty texts and a zero time, in all three lists of entries."""
    from postloom.operators import digest as d
    entry = ("r1", "work", 1, None, None, None, None, "Useful", "high", True, 0.5, None, "s", ["k", None], [], None, None, "b")
    rows = spark.createDataFrame([entry], "run_id string, account_label string, uid bigint, subject string, from_addr string, "
                                 "date timestamp_ntz, is_read boolean, label string, priority string, classified boolean, "
                                 "confidence double, reason string, summary string, key_points array<string>, "
                                 "action_items array<string>, error string, stage string, excerpt string")
    options = DigestOptions()
    head = ["### 1. ", "", "**From:**  | **Date:** 0001-01-01 00:00", "**Status:** 🆕 Unread"]

    def lines(df):
        return [r.text for r in df.orderBy(*d.ORDER).collect()]

    assert lines(d.attention_lines(rows, options))[1:5] == head
    listed = lines(d.label_lines(rows, options))
    assert listed[2:6] == head and "- " in listed and not any("null" in x for x in listed)
    runs = spark.createDataFrame([("r1", T0)], "run_id string, generated_at timestamp_ntz")
    none = spark.createDataFrame([], "run_id string, account_label string")
    plain = d.fallback_lines(runs, none.select("run_id"), none, rows, DigestOptions(
        include_global_stats=False, include_account_stats=False))
    assert head == lines(plain)[lines(plain).index("### 1. "):][:4]
    headers = spark.createDataFrame([("a", 1, None, None, None, T0)], "account_label string, uid bigint, subject string, "
                                    "from_addr string, envelope_date timestamp_ntz, internal_date timestamp_ntz")
    bodies = spark.createDataFrame([], "account_label string, uid bigint, body string")
    row = messages.assemble(headers, bodies).first()
    assert (row.subject, row.from_addr, row.date, row.body) == ("", "", T0, "")


def test_large_digests_are_not_put_together(spark):
    """A text beyond the limit has its size alone; the others are whole."""
    from postloom.operators import digest as d
    rows = [("r1", 0, "", k, "", 0, "x" * 10) for k in range(5)] + [("r2", 0, "", 0, "", 0, "short"), ("r2", 0, "", 1, "", 0, "")]
    lines = spark.createDataFrame(rows, "run_id string, section int, grp string, item bigint, key string, line int, text string")
    out = {r.run_id: (r.bytes, r.payload, r.payload_hash is None) for r in d.assemble(lines, 20).collect()}
    assert out == {"r1": (54, None, True), "r2": (6, "short\n", False)}
    assert d.assemble(lines).where("payload is null").count() == 0
