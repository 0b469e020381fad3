"""Run log: step states, progress and run results from step events.

Events: run_id, step, event (started | completed | failed), ts, and optionally
error and metadata MAP<STRING,STRING>.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.functions.exprs import half_up, join_on

# The seven tracked steps.
TRACKED_STEPS = (
    "preprocess_fields", "classify_fields", "llm_mapping", "resolve_conflicts",
    "validate_mapping", "calculate_confidence", "generate_output",
)


def _seconds(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)).cast("double") / F.lit(1e6)


def as_instant(ts: Column) -> Column:
    return ts.cast("timestamp")


def status_aggregates(has_error: bool) -> list[Column]:
    """The aggregates of a step's state, shared by batch and stream.

    Events at the same instant count in the order started, completed, failed.
    """
    ts, event = as_instant(F.col("ts")), F.col("event")
    when = F.struct(ts, F.when(event == "started", 0).when(event == "completed", 1).otherwise(2))
    state = F.when(event == "started", "running").otherwise(event)
    ended = event.isin("completed", "failed")
    aggs = [
        F.max_by(state, when).alias("status"),
        F.max(F.when(event == "started", ts)).alias("start_time"),
        F.max(F.when(ended, ts)).alias("end_time"),
    ]
    if has_error:
        failed = event == "failed"
        aggs.append(
            F.max_by(F.when(failed, F.col("error")),
                     F.when(failed, F.struct(ts, F.col("error")))).alias("error")
        )
    return aggs


def with_duration(states: DataFrame) -> DataFrame:
    """Seconds from the last start to the last end, when the end came later."""
    done = F.col("end_time") >= F.col("start_time")
    return states.withColumn(
        "duration", F.when(done, _seconds(F.col("start_time"), F.col("end_time")))
    )


def step_status(events: DataFrame) -> DataFrame:
    """Latest status, times, error and merged metadata per (run, step).

    Events are read once: they are laid out by metadata key, and what their states are by key is reduced again.
    Nothing else than maxima is taken, so an event that comes once for each of its keys counts as one.
    """
    aggregates = status_aggregates("error" in events.columns)
    if "metadata" not in events.columns:
        return with_duration(events.groupBy("run_id", "step").agg(*aggregates))
    ts, event = as_instant(F.col("ts")), F.col("event")
    rank = F.when(event == "started", 0).when(event == "completed", 1).otherwise(2)
    failed = F.when(event == "failed", F.struct(ts.alias("ts"), F.col("error"))) if "error" in events.columns else F.lit(None)
    laid = events.select("run_id", "step", F.struct(ts.alias("ts"), rank.alias("rank"), event.alias("event")).alias("last"),
                         F.when(event == "started", ts).alias("start_time"),
                         F.when(event.isin("completed", "failed"), ts).alias("end_time"), failed.alias("failed"),
                         "metadata")
    laid = laid.select("run_id", "step", "last", "start_time", "end_time", "failed",
                       F.explode_outer("metadata").alias("key", "value"))
    maxima = [F.max(c).alias(c) for c in ("last", "start_time", "end_time", "failed")]
    by_key = laid.groupBy("run_id", "step", "key").agg(*maxima, F.max(F.struct(F.col("last.ts").alias("ts"), "value")).alias("__v"))
    entry = F.when(F.col("key").isNotNull(), F.struct(F.col("key").alias("key"), F.col("__v.value").alias("value")))
    states = by_key.groupBy("run_id", "step").agg(*maxima, F.sort_array(F.collect_list(entry)).alias("__m"))
    state = F.when(F.col("last.event") == "started", "running").otherwise(F.col("last.event"))
    shown = [F.col("failed.error").alias("error")] if "error" in events.columns else []
    return with_duration(states.select(
        "run_id", "step", state.alias("status"), "start_time", "end_time", *shown,
        F.when(F.size("__m") > 0, F.map_from_entries("__m")).alias("metadata"))).select(
        "run_id", "step", "status", "start_time", "end_time", *[c for c in ("error",) if shown], "duration", "metadata")


def step_rows(events: DataFrame, steps: Sequence[str] = TRACKED_STEPS) -> DataFrame:
    """One row per run and tracked step in order; steps without events are pending.

    A run that only has other steps has all tracked ones pending.
    """
    states = step_status(events)
    shown = [c for c in ("status", "duration", "error", "metadata") if c in states.columns]
    state = F.struct("step", *shown)
    # at most one struct per tracked step in a run's row
    runs = states.groupBy("run_id").agg(F.collect_list(F.when(F.col("step").isin(*steps), state)).alias("__s"))
    rows = runs.select("run_id", "__s", F.posexplode(F.array(*[F.lit(s) for s in steps])).alias("step_no", "step"))
    rows = rows.withColumn("__x", F.get(F.filter("__s", lambda s: s["step"] == F.col("step")), F.lit(0)))
    return rows.select("run_id", "step_no", "step", F.coalesce("__x.status", F.lit("pending")).alias("status"),
                       *[F.col(f"__x.{c}").alias(c) for c in shown if c != "status"])


def progress_summary(events: DataFrame, steps: Sequence[str] = TRACKED_STEPS) -> DataFrame:
    """Completed, failed, running and pending steps per run, percentage, elapsed.

    Steps that are not tracked are ignored in the counts.
    """
    total = len(steps)
    state = F.col("status")
    known = F.col("step").isin(*steps)
    runs = step_status(events.drop("metadata")).groupBy("run_id").agg(
        F.count_if(known & (state == "completed")).alias("completed_steps"),
        F.count_if(known & (state == "failed")).alias("failed_steps"),
        F.count_if(known & (state == "running")).alias("running_steps"),
        F.min("start_time").alias("__from"),
        F.max(F.greatest("start_time", "end_time")).alias("__to"),
    )
    busy = F.col("completed_steps") + F.col("failed_steps") + F.col("running_steps")
    return runs.select(
        "run_id", F.lit(total).alias("total_steps"),
        "completed_steps", "failed_steps", "running_steps",
        (F.lit(total) - busy).alias("pending_steps"),
        half_up(F.col("completed_steps") / F.lit(float(total)) * 100, 2).alias(
            "progress_percentage"
        ),
        _seconds(F.col("__from"), F.col("__to")).alias("elapsed"),
    )


def run_summary(events: DataFrame, steps: Sequence[str] = TRACKED_STEPS) -> DataFrame:
    """Success flag, success rate and total duration per run."""
    return progress_summary(events, steps).select(
        "run_id", (F.col("completed_steps") == F.col("total_steps")).alias("success"),
        F.col("progress_percentage").alias("success_rate"),
        F.col("elapsed").alias("total_duration"), "completed_steps", "total_steps",
    )
