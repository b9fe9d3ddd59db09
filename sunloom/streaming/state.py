"""Current state of every device: a change log of newest readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.functions.grading import is_online
from sunloom.operators.fleet import upsert_latest
from sunloom.streaming.log import EVERY, ChangeLog


def _newest(rows: DataFrame) -> DataFrame:
    return upsert_latest(rows, rows.limit(0), ["inverter_id"], "ts", "reading_id")


def current_rows(scored: DataFrame) -> DataFrame:
    """Newest scored reading per device by event time, whatever the arrival order."""
    return _newest(scored.select("inverter_id", "ts", "reading_id", "category",
                                 is_online(F.col("category"), F.col("op_state")).alias("is_online")))


def device_log(spark: SparkSession, folder: str, every: int = EVERY) -> ChangeLog:
    return ChangeLog(spark, folder, _newest, every)


def read_state(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The state as it is, or as the batch `before` found it."""
    return device_log(spark, folder).read(before)


def merge_batch(scored: DataFrame, batch: int, folder: str, every: int = EVERY) -> None:
    """Write the newest reading of each device of the batch. Running a batch again writes the same."""
    device_log(scored.sparkSession, folder, every).write(current_rows(scored), batch)
