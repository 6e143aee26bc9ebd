"""The previous completed run of every run, and count changes against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def previous_runs(runs: DataFrame, snapshots: DataFrame, now: Column | None = None) -> DataFrame:
    """``(run_id, prev_run_id)``: the latest completed run with a snapshot that finished strictly
    before this one; an unfinished run is compared at ``now``. Runs without predecessor have null.

    Only the distinct finish times are ordered: inside a day by a window per day, across days by a
    window over one row per calendar day. No task sees all runs, and no theta join is needed.
    """
    cutoff = F.coalesce(F.col("finished_at"), now if now is not None else F.current_timestamp())
    has_snapshot = snapshots.select(F.col("run_id").alias("id"), F.lit(True).alias("_snap"))
    rows = runs.join(has_snapshot, "id", "left").select(
        F.col("id").alias("run_id"), cutoff.alias("at"),
        F.when((F.col("status") == "completed") & F.col("finished_at").isNotNull() & F.col("_snap"),
               F.col("id")).alias("candidate"))
    moments = rows.groupBy("at").agg(F.max("candidate").alias("candidate")).withColumn(
        "day", F.to_date("at"))
    in_day = Window.partitionBy("day").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    days_before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = moments.groupBy("day").agg(
        F.max_by("candidate", F.when(F.col("candidate").isNotNull(), F.col("at"))).alias("latest")
    ).select("day", F.last("latest", ignorenulls=True).over(days_before).alias("carried"))
    found = moments.withColumn(
        "earlier", F.last("candidate", ignorenulls=True).over(in_day)
    ).join(days, "day").select("at", F.coalesce("earlier", "carried").alias("prev_run_id"))
    return rows.join(found, ["at"], "left").select("run_id", "prev_run_id")


def count_delta(current: DataFrame, previous_of: DataFrame, snapshot: DataFrame,
                key: str) -> DataFrame:
    """Counts of a run beside those of its predecessor (0 when absent).

    Runs without predecessor are left out. ``current`` and ``snapshot`` hold ``run_id, key, n``; of a
    long history only the predecessors' rows are shuffled.
    """
    pairs = previous_of.where(F.col("prev_run_id").isNotNull())
    now = current.join(pairs, ["run_id"], "inner")
    needed = pairs.select("prev_run_id").distinct()
    before = snapshot.select(F.col("run_id").alias("prev_run_id"), key, F.col("n").alias("prev_n")).join(needed, ["prev_run_id"], "left_semi")
    joined = now.join(before, ["prev_run_id", key], "left")
    return joined.select("run_id", key, "n", F.coalesce("prev_n", F.lit(0)).alias("prev_n"))
