"""Alerts that late readings correct: a log of alerts, each raised (+1) or withdrawn (-1).

An alert depends on a reading and the one before it in event time. A late reading therefore changes the alert of the reading
after it and brings its own. Per micro-batch the alerts of the batch's devices are computed from their recent readings, with
and without the batch; the difference is what the log gets. Folded by sign, the log equals the alerts of the whole history in
order of time, whatever the order of arrival within the lateness bound.

Recent readings are a change log: those within the bound, and the newest older one of each device. A reading that arrives after
the bound has passed is left out of alerts. A reading that comes again (same device, time and id) changes nothing.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.operators.fleet import upsert_latest
from sunloom.streaming.alerts import alerts
from sunloom.streaming.log import EVERY, ChangeLog

READING = ["inverter_id", "reading_id", "ts", "category", "fault_type"]
ALERT = ["inverter_id", "reading_id", "ts", "category_from", "category_to", "type", "message"]


def _bound(rows: DataFrame, late: str) -> DataFrame:
    """One row: the time before which readings are too late."""
    return rows.agg((F.max("ts") - F.expr(f"INTERVAL {late}")).alias("bound"))


def recent_log(spark: SparkSession, folder: str, late: str, every: int = EVERY) -> ChangeLog:
    def keep(rows: DataFrame) -> DataFrame:
        rows = rows.dropDuplicates(["inverter_id", "reading_id", "ts"])
        marked = rows.withColumn("__bound", _bound(rows, late).scalar())
        inside = marked.where(F.col("ts") >= F.col("__bound")).select(READING)
        older = marked.where(F.col("ts") < F.col("__bound")).select(READING)
        return inside.unionByName(upsert_latest(older, older.limit(0), ["inverter_id"], "ts", "reading_id"))
    return ChangeLog(spark, folder, keep, every)


def changes(batch: DataFrame, history: DataFrame | None) -> DataFrame:
    """What a batch of readings does to the alerts: rows of `ALERT` and sign."""
    if history is None:
        return alerts(batch).select(*ALERT, F.lit(1).alias("sign"))
    known = history.join(batch.select("inverter_id").distinct(), "inverter_id", "left_semi")
    together = known.unionByName(batch).dropDuplicates(["inverter_id", "reading_id", "ts"])
    old, new = alerts(known).select(ALERT), alerts(together).select(ALERT)
    return new.exceptAll(old).withColumn("sign", F.lit(1)).unionByName(old.exceptAll(new).withColumn("sign", F.lit(-1)))


def correct_batch(scored: DataFrame, number: int, folder: str, late: str, every: int = EVERY) -> None:
    """Write the batch's changes of the alert log, then its readings; both replace what an earlier try wrote."""
    spark = scored.sparkSession
    log = recent_log(spark, os.path.join(folder, "recent"), late, every)
    rows = scored.select([c if c in scored.columns else F.lit(None).cast("string").alias(c) for c in READING])
    history = log.read(before=number)
    if history is not None:
        rows = rows.where(F.col("ts") >= _bound(history, late).scalar())
    changes(rows, history).write.mode("overwrite").parquet(os.path.join(folder, "alerts", f"batch={number}"))
    log.write(rows, number)


def folded(log: DataFrame) -> DataFrame:
    """The alerts that stand."""
    return log.groupBy(*ALERT).agg(F.sum("sign").alias("sign")).where("sign > 0").drop("sign")
