"""Cases that once gave wrong or missing rows."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from postloom.functions import text
from postloom.operators import prompts, ranking, replies
from postloom.params import TriageOptions
from postloom.sources import envelopes

ITEM = ('{"uid": 1, "account": "a", "label": "Useful", "confidence": 0.5, "reason": "r", "summary": %s, '
        '"key_points": %s, "action_items": [], "priority": "low"}')
GOOD = '{"schema_version": 1, "classifications": [' + ITEM % ('"s"', '["p"]') + "]}"


@pytest.mark.parametrize("raw", [
    GOOD + "]}", GOOD + "]} trailing {x}", GOOD + " " + GOOD, GOOD + "],\"end\":1}", GOOD.replace('"s"', "'s'"),
    GOOD.replace("0.5", "NaN"), GOOD.replace('"s"', "5"), GOOD.replace('["p"]', '"p"'), GOOD.replace('["p"]', "[1]"),
    GOOD.replace('"low"', '{"x": "low"}'), GOOD.replace('"reason": "r"', '"reason": ["r"]')])
def test_reply_json_is_strict(spark, raw):
    df = spark.createDataFrame([("r", "b", raw)], "run_id string, batch_id string, raw string")
    assert replies.parse_replies(df).first().parse_error == "parse: invalid JSON"


def test_good_replies_stay_good(spark):
    cases = [GOOD, GOOD.replace('"reason": "r"', '"reason": null'), GOOD.replace('"r"', '"r", "more": {"summary": 4}'),
             "```json\n" + GOOD + "\n```"]
    df = spark.createDataFrame([("r", str(k), c) for k, c in enumerate(cases)], "run_id string, batch_id string, raw string")
    assert [r.parse_error for r in replies.parse_replies(df).collect()] == [None] * len(cases)


def test_quoted(spark):
    cases = {'a"b\\c': '"a\\"b\\\\c"', "x\ny\tz": '"x\\ny\\tz"', "\x01é​  ": '"\\x01é\\u200b\\u00a0 "', "": '""'}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert [r.q for r in df.select(text.quoted(F.col("c")).alias("q")).collect()] == list(cases.values())


def test_numbers_keep_null_groups_and_split_one_second(spark):
    at = dt.datetime(2024, 1, 1)
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 50 == 0, None).otherwise("r").alias("run_id"),
        F.when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("a"), F.col("id") % 3)).alias("account_label"),
        (F.col("id") * 977).alias("uid"), F.lit("high").alias("priority"),
        F.when(F.col("id") % 11 == 0, None).otherwise(F.lit(at)).alias("date"))
    got = ranking.number_entries(rows, ["run_id"])
    order = Window.partitionBy("run_id").orderBy(F.desc("date"), F.asc("account_label"), F.asc("uid"))
    want = rows.withColumn("item", F.row_number().over(order).cast("bigint"))
    assert got.count() == 20_000
    assert got.exceptAll(want.select(got.columns)).count() == 0


def test_a_message_without_headers_stays_in_its_prompt(spark):
    df = spark.createDataFrame(
        [("r", "b", "a", 1, None, None, None, None, "body one"), ("r", "b", "a", 2, "x@y", "s", None, True, None)],
        "run_id string, batch_id string, account_label string, uid bigint, from_addr string, subject string, "
        "date timestamp_ntz, is_read boolean, body string")
    row = prompts.build_prompts(df, system_prompt="Be brief.").first()
    assert row.n_messages == 2 and row.prompt.count("<<< EMAIL ") == 2 and row.prompt.startswith("Be brief.\n\n")


def test_unknown_providers_give_rows(spark):
    df = spark.createDataFrame([("r", str(k), p, 200, "{}") for k, p in enumerate(["gemini", "other", None])],
                               "run_id string, batch_id string, provider string, http_status int, body string")
    out = {r.batch_id: r.reply_error for r in envelopes.extract_replies(df).collect()}
    assert out == {"0": "gemini.classify: no candidates returned", "1": "unknown provider: other", "2": "unknown provider: "}


def test_charsets_by_row(spark):
    rows = [(bytearray("Привет".encode("koi8-r")), "KOI8-R"), (bytearray("日本".encode("shift_jis")), "Shift_JIS"),
            (bytearray("€".encode("cp1252")), "windows-1252"), (bytearray(b"a\xff"), "utf-8"), (bytearray(b"a"), "none-such"),
            (bytearray(b"ok"), None), (None, "utf-8")]
    df = spark.createDataFrame(rows, "b binary, c string")
    out = [r.t for r in df.select(text.convert_charset(F.col("b"), F.col("c")).alias("t")).collect()]
    assert out == ["Привет", "日本", "€", "a�", None, "ok", None]


def test_one_repair_at_most():
    with pytest.raises(ValueError):
        TriageOptions(repair_attempts=3)
