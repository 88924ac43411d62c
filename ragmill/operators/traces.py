"""Trace index and step accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.operators.evaluate import latency_summary


def trace_index(traces: DataFrame) -> DataFrame:
    """One row a trace: ids, intent, times, latency from start to end, status, error and step counts, head of the goal."""
    ms = (F.unix_micros(F.to_timestamp("end_time")) - F.unix_micros(F.to_timestamp("start_time"))) / 1000
    return traces.select("trace_id", "session_id", "intent", "start_time", "end_time", F.bround(ms, 0).cast("long").alias("latency_ms"), "final_status", F.size(F.filter("steps", lambda s: s["status"] == "failed")).alias("error_count"), F.size("steps").alias("n_steps"), F.substring("goal", 1, 100).alias("goal"))


def steps(traces: DataFrame) -> DataFrame:
    return traces.select("trace_id", F.explode("steps").alias("s")).select("trace_id", "s.*")


def step_accounting(step_rows: DataFrame) -> DataFrame:
    """By step type: counts by status, and latency percentiles of steps that have one."""
    n = step_rows.groupBy("step_type").agg(F.count("*").alias("n_steps"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("success", "failed", "skipped")))
    return n.join(latency_summary(step_rows, "latency_ms", ["step_type"]).drop("n"), "step_type", "left")
