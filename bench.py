"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then timed; the time is the median of the timed runs. Results
go to the noop sink, so every row and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from postloom import catalog
from postloom.plans.tables import Tables
from postloom.session import local_session, use_shared_folder

HEADLINE = [
    "join_01_skip_processed",
    "agg_01_run_stats",
    "agg_09_sender_counts",
    "win_01_label_order",
    "win_04_top_senders_per_account",
    "win_06_fetch_batches",
    "join_06_previous_run",
    "join_07_sender_delta",
    "hl_04_sender_bursts",
    "str_01_strip_html",
    "str_04_decode_entities",
    "src_07_header_body_assembly",
    "json_03_valid_items",
    "llm_01_prompts",
    "dig_05_label_sections",
    "stm_04_run_counts_by_sender",
    "stm_05_bursts",
    "src_06_mime_bodies",
    "llm_03_accepted",
    "flow_03_triage_pass",
    "src_01_landed_window",
    "join_01_ledger_lookup",
    "stm_05_sender_state",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session("postloom-bench", cpus, shuffle_partitions=int(cpus))
    use_shared_folder(tempfile.mkdtemp(prefix="postloom-bench-"))
    catalog.load()
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for attempt in range(repeats + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](Tables(spark, folder)).write.format("noop").mode("overwrite").save()
            if attempt:
                runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
    print(json.dumps({
        "metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
