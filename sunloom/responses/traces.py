"""Call-trace analytics: listings, summaries, percentiles and parent-child nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.functions.numeric import even_round, ratio
from sunloom.functions.timeparts import iso_timestamp, seconds_between
from sunloom.operators.fleet import top_per
from sunloom.operators.quantiles import exact_quantiles


def timed(traces: DataFrame) -> DataFrame:
    """Parsed times and latency in seconds; unreadable times give no latency."""
    start, end = iso_timestamp(F.col("start_time")), iso_timestamp(F.col("end_time"))
    return traces.withColumns({"started": start, "latency_s": seconds_between(start, end)})


def fetch(traces: DataFrame, as_of: Column, hours: int, limit: int | None = None) -> DataFrame:
    """Root runs of the last hours, newest first."""
    recent = timed(traces).where(F.col("is_root") & (F.col("started") >= as_of - F.expr(f"INTERVAL {hours} HOURS")))
    return recent if limit is None else recent.orderBy(F.desc("started"), "run_id").limit(limit)


def _stats() -> list[Column]:
    tokens = F.coalesce("total_tokens", F.lit(0))
    return [F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "error").alias("errors"),
            F.count_if(F.col("status") == "success").alias("successful"),
            F.avg("latency_s").alias("avg_s"), F.min("latency_s").alias("min_s"), F.max("latency_s").alias("max_s"),
            F.sum(tokens).alias("tokens"), F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"),
            F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"), F.avg(tokens).alias("avg_tokens")]


def summary(timed_traces: DataFrame) -> DataFrame:
    return timed_traces.agg(*_stats()).withColumn(
        "success_rate", even_round(F.coalesce(ratio(F.col("successful") * 100.0, F.col("n")), F.lit(0.0)), 1))


def by_name(timed_traces: DataFrame) -> DataFrame:
    return timed_traces.groupBy(F.coalesce("name", F.lit("unknown")).alias("name")).agg(*_stats())


def percentiles(timed_traces: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Nearest-rank p50 and p95: the value at sorted index floor(n * p)."""
    by = by or []
    q = exact_quantiles(timed_traces, ["latency_s"], [0.50, 0.95], by, method="nearest")
    return q.groupBy(*by).agg(F.max(F.when(F.col("p") == 0.50, F.col("value"))).alias("p50_s"),
                              F.max(F.when(F.col("p") == 0.95, F.col("value"))).alias("p95_s"))


def with_children(traces: DataFrame, keep: int | None = None) -> DataFrame:
    """Root runs with the nested list of their steps; `keep` limits the list of a run to its first steps, for a listing."""
    steps = traces.where(F.col("parent_id").isNotNull()).select("parent_id", F.struct("run_id", "name", "status").alias("step"))
    first = steps if keep is None else top_per(steps, ["parent_id"], [F.col("step.run_id")], keep)
    lists = first.groupBy("parent_id").agg(F.sort_array(F.collect_list("step")).alias("children"))
    return traces.where("is_root").join(lists.withColumnRenamed("parent_id", "run_id"), "run_id", "left")


def timeline(timed_traces: DataFrame) -> DataFrame:
    return timed_traces.orderBy(F.desc_nulls_last("start_time"), "run_id")
