"""Alerts from changes of grade. The last grade of every device is the state kept between micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunloom.functions.grading import alert_message, alert_type
from sunloom.operators import series


def grade_changes(readings: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Rows whose grade differs from the device's grade before.

    Inside a micro-batch the grade before comes from the row before in event time; a device that fills most of a
    batch is cut into slices like any long series. A device's first row of the batch meets its stored state, a new
    device starts at A. A late row therefore meets the state as it is now: alerts depend on arrival, and the same
    function over the full history is the correction.
    """
    def step(frame: DataFrame, part: list[str]) -> DataFrame:
        return frame.withColumn("before", F.lag("category").over(Window.partitionBy(*part).orderBy("ts", "reading_id")))

    fault = F.col("fault_type") if "fault_type" in readings.columns else F.lit(None).cast("string").alias("fault_type")
    rows = readings.select("inverter_id", "reading_id", "ts", "category", fault)
    moved = series.over_series(rows, ["inverter_id"], "ts", "reading_id", step, behind=1)
    if state is None:
        known = moved.withColumn("category_from", F.coalesce("before", F.lit("A")))
    else:
        last = state.select("inverter_id", F.col("category").alias("stored"))
        known = moved.join(last, "inverter_id", "left").withColumn("category_from", F.coalesce("before", "stored", F.lit("A")))
    return known.where(F.col("category_from") != F.col("category")).select(
        "inverter_id", "reading_id", "ts", "category_from", F.col("category").alias("category_to"), "fault_type")


def alerts(readings: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Alert rows by the rule the batch query uses."""
    kind = alert_type(F.col("category_from"), F.col("category_to"))
    device = F.concat(F.lit("INV-"), F.col("inverter_id").cast("string"))
    changes = grade_changes(readings, state).withColumn("type", kind).where(F.col("type").isNotNull())
    return changes.withColumn("message", alert_message(F.col("type"), F.col("fault_type"), device)).drop("fault_type")
