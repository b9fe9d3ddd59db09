"""The live loop: readings in, scored facts, device state, alerts, tickets and counters out."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sunloom.functions import grading
from sunloom.learning import serving
from sunloom.streaming.alerts import alerts
from sunloom.streaming.corrections import correct_batch
from sunloom.streaming.log import EVERY
from sunloom.streaming.state import device_log, merge_batch


def unique_readings(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One row per device and time within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["inverter_id", "ts"])


def scored(readings: DataFrame, probabilities: Column) -> DataFrame:
    """Grade, fault wording and flags of every reading; works on streams and on tables."""
    return serving.graded(readings, probabilities)


def tickets(scored_rows: DataFrame) -> DataFrame:
    """A ticket row for every high-risk reading."""
    high = scored_rows.where(grading.risk_band(F.col("risk_score")) == "critical")
    return high.select("inverter_id", "reading_id", "ts", "risk_score",
                       grading.ticket_id(F.col("ts"), F.col("inverter_id").cast("string"),
                                         F.col("reading_id").cast("string")).alias("ticket_id"),
                       grading.ticket_priority(F.col("risk_score")).alias("priority"),
                       (F.col("risk_score") > 0.8).alias("escalate"))


def counters(stream: DataFrame) -> DataFrame:
    """Processed and critical readings so far; run it in update or complete mode."""
    return stream.groupBy().agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("category") == "E").alias("critical"))


def run_live(stream: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None,
             model: serving.RiskModel | None = None, late: str | None = None, every: int = EVERY) -> StreamingQuery:
    """Per micro-batch: score the readings, write the facts, the alerts, and the changes of the devices' state.

    Without a `model` the stream must be scored already. Alerts are raised against the state so far; with `late`, an interval
    such as "1 hour", alerts are a log with signs that readings up to that late correct (see `corrections`).

    Each write replaces the batch's own directory, so a batch that runs again after a failure leaves one copy.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        facts = os.path.join(folder, "facts", f"batch={number}")
        rows = batch if model is None else serving.score_readings(batch, model)
        rows.write.mode("overwrite").parquet(facts)
        stored = spark.read.schema(rows.schema).parquet(facts)
        states = os.path.join(folder, "state")
        if late is None:
            before = device_log(spark, states).read(before=number)
            if before is not None:
                before = before.join(stored.select("inverter_id").distinct(), "inverter_id", "left_semi")
            alerts(stored, before).write.mode("overwrite").parquet(os.path.join(folder, "alerts", f"batch={number}"))
        else:
            correct_batch(stored, number, folder, late, every)
        merge_batch(stored, number, states, every)

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "15 seconds"})).start())
