"""Literal replies and what is accepted of them."""

import json

import pytest
from pyspark.sql import functions as F

from postloom.operators import replies


def item(uid=1, account="work", **changes):
    base = {"uid": uid, "account": account, "label": "Useful", "confidence": 0.9, "reason": "r",
            "summary": "s", "key_points": ["p"], "priority": "high"}
    return {k: v for k, v in {**base, **changes}.items() if v is not None}


def doc(*items, version=1):
    return json.dumps({"schema_version": version, "classifications": list(items)})


def parse(spark, raw, labels=("Useful", "ToDelete", "Ads")):
    df = spark.createDataFrame([("r", "b", raw)], "run_id string, batch_id string, raw string")
    parsed = replies.parse_replies(df, labels)
    return parsed.first().parse_error, replies.valid_items(parsed).orderBy("pos").collect()


def test_valid_reply(spark):
    error, rows = parse(spark, doc(item(1), item(2, label="Unknown", action_items=["do"])))
    assert error is None
    assert [(r.account_label, r.uid, r.label, r.priority) for r in rows] == [
        ("work", 1, "Useful", "high"), ("work", 2, "Unknown", "high")]
    assert rows[1].action_items == ["do"] and rows[0].action_items == []


@pytest.mark.parametrize("wrap", ["```json\n{}\n```", "```\n{}\n```", "Sure! {} Anything else?", "\n {} \n"])
def test_surroundings_are_dropped(spark, wrap):
    error, rows = parse(spark, wrap.replace("{}", doc(item())))
    assert error is None and len(rows) == 1


@pytest.mark.parametrize("raw, error", [
    ("", "parse: empty response"),
    ("  \n", "parse: empty response"),
    ("no json at all", "parse: invalid JSON"),
    (doc(item())[:-3], "parse: invalid JSON"),
    (doc(item()) + "\n" + doc(item()), "parse: invalid JSON"),
    (doc(item(uid="seven")), "parse: invalid JSON"),
    (doc(item(uid=1.5)), "parse: invalid JSON"),
    (doc(item(uid=4294967296)), "parse: invalid JSON"),
    (doc(item(uid=-1)), "parse: invalid JSON"),
    ('{"schema_version": "1", "classifications": []}', "parse: invalid JSON"),
    ('{"classifications": {"uid": 1}}', "parse: invalid JSON"),
    (doc(item(), version=2), "parse: unsupported schema_version 2 (max supported: 1)"),
    (doc(item(), version=-1), "parse: invalid schema_version -1 (must be >= 0)"),
    (doc(), "parse: empty classifications array"),
    ("{}", "parse: empty classifications array"),
])
def test_refused_documents(spark, raw, error):
    got, rows = parse(spark, raw)
    assert got == error and rows == []


def test_missing_version_is_accepted(spark):
    error, rows = parse(spark, json.dumps({"classifications": [item()]}))
    assert error is None and len(rows) == 1


@pytest.mark.parametrize("bad, message", [
    (item(label="Spam"), 'unknown label "Spam" for work/1'),
    (item(label='a"b'), 'unknown label "a\\"b" for work/1'),
    (item(confidence=1.01), "confidence 1.010000 out of range [0,1] for work/1"),
    (item(confidence=-0.5), "confidence -0.500000 out of range [0,1] for work/1"),
    (item(priority="urgent"), 'invalid priority "urgent" for work/1'),
    (item(priority="", urgency="soon"), 'invalid priority "soon" for work/1'),
    (item(summary=" "), "empty summary for work/1"),
    (item(summary=None), "empty summary for work/1"),
    (item(key_points=[]), "empty key_points for work/1"),
    (item(key_points=None), "empty key_points for work/1"),
])
def test_item_checks(spark, bad, message):
    error, rows = parse(spark, doc(bad, item(2)))
    assert error == f"parse: 1/2 items invalid: item 0: {message}"
    assert [r.uid for r in rows] == [2]
    assert parse(spark, doc(bad))[0] == f"parse: all 1 items invalid: item 0: {message}"


def test_every_blank_point_counts(spark):
    error, _ = parse(spark, doc(item(key_points=["a", " ", ""])))
    assert error == ("parse: all 1 items invalid: item 0: empty key_points[1] for work/1; "
                     "item 0: empty key_points[2] for work/1")


def test_first_of_a_key_counts_even_when_invalid(spark):
    error, rows = parse(spark, doc(item(label="Nope"), item(), item(2), item(2, account="home")))
    assert error.endswith("item 1: duplicate key work/1")
    assert [(r.account_label, r.uid) for r in rows] == [("work", 2), ("home", 2)]


@pytest.mark.parametrize("priority, urgency, expected", [
    (" HIGH ", "", "high"), ("", "Normal", "medium"), ("", "low", "low"), ("", "", ""),
    ("low", "high", "low"), (None, None, "")])
def test_priority(spark, priority, urgency, expected):
    _, rows = parse(spark, doc(item(priority=priority, urgency=urgency)))
    assert rows[0].priority == expected


REQUEST = "run_id string, batch_id string, account_label string, uid bigint"
REPLY = "run_id string, batch_id string, attempt int, raw string, reply_error string"


def fallback(spark, wanted, answers, attempts=1):
    valid, failed, _ = replies.partial_fallback(
        spark.createDataFrame([("r", b, "work", u) for b, u in wanted], REQUEST),
        spark.createDataFrame([("r", *a) for a in answers], REPLY), repair_attempts=attempts)
    return ({r.uid: (r.label, r.attempt) for r in valid.collect()},
            {r.uid: (r.stage, r.error) for r in failed.collect()})


BROKEN = doc(item(1), item(2, label="Nope"))


def test_repair_fills_the_gaps_only(spark):
    valid, failed = fallback(spark, [("b", 1), ("b", 2), ("b", 3)], [
        ("b", 0, BROKEN, None), ("b", 1, doc(item(1, label="Ads"), item(2, label="Ads")), None)])
    assert valid == {1: ("Useful", 0), 2: ("Ads", 1)}
    assert failed == {3: ("repair", "repair did not produce valid analysis for this item")}


def test_invalid_repair_is_not_used_in_part(spark):
    valid, failed = fallback(spark, [("b", 1), ("b", 2), ("b", 3)], [
        ("b", 0, BROKEN, None), ("b", 1, doc(item(2), item(3, label="Nope")), None)])
    assert valid == {1: ("Useful", 0)}
    assert {s for s, _ in failed.values()} == {"repair"}
    assert failed[2][1].startswith("repair produced invalid response: parse: 1/2 items invalid")


def test_failed_and_missing_repair(spark):
    answers = [("b", 0, BROKEN, None)]
    assert fallback(spark, [("b", 2)], answers)[1] == {2: ("repair", "repair failed: no reply")}
    answers.append(("b", 1, None, "quota"))
    assert fallback(spark, [("b", 2)], answers)[1] == {2: ("repair", "repair failed: quota")}


def test_repair_switched_off(spark):
    valid, failed = fallback(spark, [("b", 1), ("b", 2)], [
        ("b", 0, BROKEN, None), ("b", 1, doc(item(2)), None)], attempts=0)
    assert valid == {1: ("Useful", 0)}
    assert failed[2] == ("parse", "parse/validation failed: parse: 1/2 items invalid: "
                                  'item 1: unknown label "Nope" for work/2')


def test_silent_gap_is_no_failure(spark):
    valid, failed = fallback(spark, [("b", 1), ("b", 2)], [("b", 0, doc(item(1)), None)])
    assert set(valid) == {1} and failed == {}


def test_failed_calls(spark):
    one = [("a", 0, doc(item(1)), None), ("b", 0, None, "timeout")]
    valid, failed = fallback(spark, [("a", 1), ("b", 2), ("c", 3)], one)
    assert set(valid) == {1}
    assert failed == {2: ("classify", "initial classify: timeout"),
                      3: ("classify", "initial classify: no reply")}
    assert fallback(spark, [("b", 2)], one[1:]) == ({}, {})  # the whole run failed: no analysis errors


def test_count_validation(spark):
    df = spark.createDataFrame([
        ("a", doc(item(1), item(2)), 2), ("b", doc(item(1)), 2), ("c", doc(), 1),
        ("d", doc(item(label="", confidence=3.0)), 0)], "batch_id string, raw string, n int")
    rows = replies.validate_counts(
        replies.parse_replies(df.withColumn("run_id", F.lit("r"))), F.col("n")).collect()
    assert {r.batch_id: r.count_error for r in rows} == {
        "a": None, "b": "validate: expected 2 classifications, got 1", "c": "validate: no classifications",
        "d": "validate: item 0: empty label for work/1; item 0: confidence 3.000000 out of range"}


def test_bare_documents_meet_no_pattern(spark):
    """Texts without fences and without anything around the braces are taken as they are; others as the patterns say."""
    from postloom.functions.reply_text import json_part, strip_fences
    texts = ['{"a": 1}', ' {"a": 1}\n', '```json\n{"a": 1}\n```', 'So: {"a": {}} done', '} {', '{', '', None, '```', '{"a": "```"}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").repartition(2)
    found = df.select("i", strip_fences(F.col("x")).alias("bare")).select("i", "bare", json_part(F.col("bare")).alias("part"))
    assert [(r.bare, r.part) for r in found.orderBy("i").collect()] == [
        ('{"a": 1}', '{"a": 1}'), ('{"a": 1}', '{"a": 1}'), ('{"a": 1}', '{"a": 1}'),
        ('So: {"a": {}} done', '{"a": {}}'), ('} {', '} {'), ('{', '{'), ('', ''), (None, None), ('', ''), ('{"a": "', '{"a": "')]
    for function in (strip_fences, json_part):
        assert "CASE WHEN" in df.select(function(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
