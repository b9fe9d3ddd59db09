"""Event indicators and the look-ahead risk label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom import config
from sunloom.functions.numeric import column_or
from sunloom.operators import series


def events(df: DataFrame, daily: str = "24h") -> dict[str, Column]:
    """Shutdown and degradation indicators of each row; shutdown outranks degradation."""
    day = column_or(df, "is_daytime", 1) == 1
    alarm = column_or(df, "alarm_code", 0)
    state = column_or(df, "op_state", config.RUNNING_STATE)
    shutdown = F.coalesce(alarm.isin(config.FAULT_ALARMS), F.lit(False))
    odd_state = ~state.isin(config.OFF_STATE, config.RUNNING_STATE)
    troubled = odd_state | alarm.isin(config.WARNING_ALARMS)
    if {"power", f"power_rmean_{daily}"} <= set(df.columns):
        usual = F.col(f"power_rmean_{daily}")
        drop = F.when(usual > config.MEANINGFUL_POWER, F.try_divide(usual - F.col("power"), usual)).otherwise(0.0)
        troubled = troubled | (drop > config.POWER_DROP)
    degraded = F.coalesce(troubled & day, F.lit(False)) & ~shutdown
    return {"shutdown_event": shutdown.cast("int"), "degradation_event": degraded.cast("int")}


def seen_ahead(part: list[str], order: list[str], event: str, rows: int) -> tuple[Column, Column]:
    """Row number from the end (store it as `__back`) and 1 when the event is in this or the next rows-1 rows.

    Read backwards, that is the distance to the latest event so far: one growing frame, whatever `rows` is.
    """
    back = Window.partitionBy(*part).orderBy(*[F.desc(c) for c in order])
    here = F.row_number().over(back)
    last = F.max(F.when(F.col(event) == 1, F.col("__back"))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    return here, F.coalesce((F.col("__back") - last < rows).cast("int"), F.lit(0))


def risk_label(shutdown_ahead: Column, degradation_ahead: Column) -> Column:
    return F.when(shutdown_ahead >= 1, 2).when(degradation_ahead >= 1, 1).otherwise(0)


def add_labels(df: DataFrame, keys: list[str] | None = None, ts: str = "timestamp", tie: str = "row_id",
               rows: int | None = None, daily: str = "24h", keep_events: bool = False,
               limit: int | None = None, hot=series.MEASURE) -> DataFrame:
    """risk_label 2 / 1 / 0: a shutdown, else a degradation, in the coming `rows` samples."""
    keys, rows = keys or config.SERIES_KEYS, rows or config.LOOKAHEAD_ROWS
    marked = df.withColumns(events(df, daily))

    def step(frame: DataFrame, part: list[str]) -> DataFrame:
        here, shutdown = seen_ahead(part, [ts, tie], "shutdown_event", rows)
        _, degradation = seen_ahead(part, [ts, tie], "degradation_event", rows)
        return (frame.withColumn("__back", here)
                .withColumns({"shutdown_ahead": shutdown, "degradation_ahead": degradation}).drop("__back"))

    ahead = series.over_series(marked, keys, ts, tie, step, ahead=rows - 1, limit=limit, hot=hot)
    labelled = ahead.withColumn("risk_label", risk_label(F.col("shutdown_ahead"), F.col("degradation_ahead")))
    helpers = ["shutdown_event", "degradation_event", "shutdown_ahead", "degradation_ahead"]
    return labelled if keep_events else labelled.drop(*helpers)


def label_shares(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows and percentage per label, over the whole table or per group."""
    by = by or []
    counts = df.groupBy(*by, "risk_label").agg(F.count(F.lit(1)).alias("n"))
    # the counts are already aggregated: a handful of rows per group
    total = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
    return counts.withColumn("share", F.col("n") * 100.0 / total)
