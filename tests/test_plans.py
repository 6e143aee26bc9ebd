"""Physical plans keep the properties the operators are written for."""

import pytest

from postloom import catalog
from postloom.plans.tables import Tables

catalog.load()

LAZY = ["src_01_search_window", "src_03_folders", "src_04_flatten_accounts", "src_07_header_body_assembly",
        "join_01_skip_processed", "join_03_partial_lookup", "join_05_repair_merge", "join_06_previous_run",
        "join_07_sender_delta", "agg_01_run_stats", "agg_09_sender_counts", "win_01_label_order",
        "win_04_top_senders_per_account", "win_06_fetch_batches", "hl_04_sender_bursts", "llm_01_prompts",
        "json_03_valid_items", "dig_05_label_sections", "stm_05_bursts"]


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairwise_join(spark, data, name):
    text = physical(catalog.QUERIES[name](Tables(spark, data)))
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text


def test_filters_and_columns_reach_the_scan(spark, data):
    text = physical(catalog.QUERIES["src_01_search_window"](Tables(spark, data)))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in text
    assert "props" not in text and "value" not in text


def test_statistics_never_read_bodies(spark, data):
    for name in ("agg_01_run_stats", "win_04_top_senders_per_account", "join_01_skip_processed"):
        assert "documents" not in physical(catalog.QUERIES[name](Tables(spark, data)))


def test_top_n_is_cut_before_the_shuffle(spark, data):
    for name in ("win_04_top_senders_per_account", "top_01_most_important", "top_02_first_fetched"):
        assert physical(catalog.QUERIES[name](Tables(spark, data))).count("WindowGroupLimit") == 2


def test_only_one_row_per_day_meets_in_one_task(spark, data):
    text = physical(catalog.QUERIES["join_06_previous_run"](Tables(spark, data)))
    for chunk in text.split("Exchange SinglePartition")[1:]:
        assert "Aggregate(key=[day" in chunk.split("\n")[1]


def test_replies_are_checked_without_a_shuffle(spark):
    from postloom.operators import replies
    raw = spark.createDataFrame([("r", "b", "{}")], "run_id string, batch_id string, raw string")
    text = physical(replies.valid_items(replies.parse_replies(raw)))
    assert "Exchange" not in text
    assert text.count("from_json(") == 1 and "parse_json" not in text  # one parse


def test_rows_are_exchanged_once_to_be_numbered(spark):
    from postloom.operators import skew
    df = spark.range(100).selectExpr("id % 3 AS g", "id AS uid")
    text = physical(skew.ranged_row_number(df, ["g"], [df.uid.asc()], "n"))
    rows = text.split("BroadcastExchange")[0]
    assert "Exchange" not in rows and "numbered" in text  # the exchange was that of the stored rows
