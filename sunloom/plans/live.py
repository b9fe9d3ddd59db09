"""Streaming jobs run over the events files until they are drained; batch SQL must give the same rows."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom import config
from sunloom.plans.registry import query, rounded
from sunloom.plans.views import r as R
from sunloom.session import SETTINGS, shared_folder
from sunloom.sources import bindings as b
from sunloom.streaming import corrections, live, rolling, stale, state


def _scratch(spark: SparkSession) -> str:
    return os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")


def _readings(spark, folder) -> DataFrame:
    return b.readings(spark, folder, b.event_stream(spark, folder, _scratch(spark)))


def _drained(stream: DataFrame) -> DataFrame:
    """Run the stream to its end into files and read them."""
    spark, root = stream.sparkSession, _scratch(stream.sparkSession)
    out = os.path.join(root, "out")
    started = (stream.writeStream.format("parquet").option("checkpointLocation", os.path.join(root, "checkpoint"))
               .trigger(availableNow=True).start(out))
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _lived(spark: SparkSession, folder: str, arrival: str = "ts", late: str | None = None) -> str:
    """The live loop run over the events files; returns its folder of facts, alerts and state."""
    root = _scratch(spark)
    out = os.path.join(root, "live")
    rows = b.readings(spark, folder, b.event_stream(spark, folder, root, arrival))
    # a base of the state after every second batch: the run reads bases and changes
    live.run_live(rows, out, os.path.join(root, "checkpoint"), {"availableNow": True}, late=late, every=2).awaitTermination()
    return out


@contextmanager
def _state_store(spark: SparkSession):
    """The state store that state of several parts needs; a query keeps the settings it starts with."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, SETTINGS[name])
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


ALERTS = ("""SELECT inverter_id, reading_id, prev AS category_from, category AS category_to, type, CASE type WHEN 'info' THEN
  concat('Performance warning: ', coalesce(fault_type, 'Minor deviation'), ' on INV-', inverter_id)
  ELSE concat(coalesce(fault_type, 'Fault'), ' detected on INV-', inverter_id) END AS message FROM (SELECT *, CASE
  WHEN category = 'E' AND prev <> 'E' THEN 'critical' WHEN category = 'D' AND prev <> 'D' THEN 'warning'
  WHEN category = 'C' AND prev NOT IN ('C', 'D', 'E') THEN 'info' END AS type FROM (SELECT *, lag(category, 1, 'A')
  OVER (PARTITION BY inverter_id ORDER BY ts, reading_id) AS prev FROM rd)) WHERE type IS NOT NULL""", ("rd",))


@query(*ALERTS)
def stream_alerts(spark, folder):
    out = _lived(spark, folder)
    return spark.read.parquet(os.path.join(out, "alerts")).select(
        "inverter_id", "reading_id", "category_from", "category_to", "type", "message")


@query(*ALERTS)
def stream_corrections(spark, folder):
    """Readings arrive in no order of time; the log of raised and withdrawn alerts, folded, is that of the ordered history."""
    out = _lived(spark, folder, arrival="xxhash64(event_id)", late="60 days")
    return corrections.folded(spark.read.parquet(os.path.join(out, "alerts"))).select(
        "inverter_id", "reading_id", "category_from", "category_to", "type", "message")


@query("""SELECT inverter_id, reading_id, category, category <> 'offline' AND op_state <> 0 AS is_online FROM (SELECT *, row_number()
  OVER (PARTITION BY inverter_id ORDER BY ts DESC, reading_id DESC) AS rn FROM rd) WHERE rn = 1""", ("rd",))
def stream_state(spark, folder):
    """Facts appended and device state merged per micro-batch; the state at the end."""
    out = _lived(spark, folder)
    return state.read_state(spark, os.path.join(out, "state")).select("inverter_id", "reading_id", "category", "is_online")


@query("""SELECT inverter_id, epoch_us(ts) AS us, count(*) AS n FROM (SELECT DISTINCT inverter_id, ts FROM rd) GROUP BY ALL""", ("rd",))
def stream_unique(spark, folder):
    rows = _readings(spark, folder)
    return _drained(live.unique_readings(rows.unionByName(rows))).groupBy(
        "inverter_id", F.unix_micros("ts").alias("us")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT reading_id, CASE WHEN s > 0.85e0 THEN 'P1-Critical' ELSE 'P2-High' END AS priority, s > 0.8e0 AS escalate,
  concat('TKT-', strftime(ts, '%Y%m%d'), '-', upper(substr(sha256(concat(inverter_id, '|', reading_id)), 1, 6))) AS ticket_id
  FROM (SELECT *, confidence AS s FROM rd) WHERE s >= 0.8e0""", ("rd",))
def stream_tickets(spark, folder):
    rows = _readings(spark, folder).withColumnRenamed("confidence", "risk_score")
    return _drained(live.tickets(rows)).select("reading_id", "priority", "escalate", "ticket_id")


@query("""SELECT count(*) AS processed, count_if(category = 'E') AS critical FROM rd""", ("rd",))
def stream_counters(spark, folder):
    """Running totals in complete mode; the last version written is the total."""
    root = _scratch(spark)
    out = os.path.join(root, "out")
    counted = live.counters(_readings(spark, folder))
    started = (counted.writeStream.outputMode("complete").option("checkpointLocation", os.path.join(root, "checkpoint"))
               .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start())
    started.awaitTermination()
    return spark.read.parquet(out)


@query("""WITH g AS (SELECT inverter_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER w AS p, lead(epoch_us(ts)) OVER w AS n FROM rd
  WINDOW w AS (PARTITION BY inverter_id ORDER BY ts)), q AS (SELECT 12 * 3600000000 AS gap, (SELECT max(epoch_us(ts)) FROM rd) AS top)
  SELECT inverter_id, t AS us, 'online' AS status FROM g, q WHERE p IS NULL OR t - p > gap
  UNION ALL SELECT inverter_id, t, 'offline' FROM g, q WHERE n - t > gap OR (n IS NULL AND t + gap < top - 60000000)""", ("rd",))
def stream_silent(spark, folder):
    """Devices going silent for more than twelve hours and coming back."""
    changes = stale.connection_changes(_readings(spark, folder), minutes=720)
    return _drained(changes).select("inverter_id", F.unix_micros("last_data_at").alias("us"), "status")


_KEYS = ", ".join(config.SERIES_KEYS)


def _frame(n: int) -> str:
    return f"OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_HOUR, _DAY = config.FRAMES["1h"], config.FRAMES["24h"]
ROLLED = ["power_rmean_1h", "temp_rstd_6h", "power_rmean_24h", "power_rstd_24h", "v_r_rmin_24h", "temp_rmax_24h", "power_lag_1d", "power_lag_7d",
          "string_imbalance_lag_1d", "power_variability", "power_variability_lag_1d", "kwh_daily_delta"]


@query(f"""WITH f AS (SELECT *, avg(power) {_frame(_HOUR)} AS power_rmean_1h, coalesce(stddev_samp(temp) {_frame(config.FRAMES['6h'])}, 0) AS temp_rstd_6h,
  avg(power) {_frame(_DAY)} AS power_rmean_24h, coalesce(stddev_samp(power) {_frame(_DAY)}, 0) AS power_rstd_24h, min(v_r) {_frame(_DAY)} AS v_r_rmin_24h,
  max(temp) {_frame(_DAY)} AS temp_rmax_24h, coalesce(lag(power, {config.LAGS['1d']}) OVER w, 0) AS power_lag_1d,
  coalesce(lag(power, {config.LAGS['7d']}) OVER w, 0) AS power_lag_7d, greatest(coalesce(kwh_total - lag(kwh_total) OVER w, 0), 0) AS kwh_daily_delta,
  greatest(pv1_current, pv2_current, pv3_current) - least(pv1_current, pv2_current, pv3_current) AS imbalance,
  CASE WHEN (alarm_code <> 0) = (lag(alarm_code <> 0) OVER w) THEN 0 ELSE 1 END AS changed FROM td WINDOW w AS (PARTITION BY {_KEYS} ORDER BY ts, event_id)),
  g AS (SELECT *, CASE WHEN power_rmean_24h > 0 THEN power_rstd_24h / power_rmean_24h ELSE 0 END AS power_variability,
  coalesce(lag(imbalance, {config.LAGS['1d']}) OVER w, 0) AS string_imbalance_lag_1d, sum(changed) OVER (w ROWS UNBOUNDED PRECEDING) AS run
  FROM f WINDOW w AS (PARTITION BY {_KEYS} ORDER BY ts, event_id)),
  h AS (SELECT *, coalesce(lag(power_variability, {config.LAGS['1d']}) OVER w, 0) AS power_variability_lag_1d,
  CASE WHEN alarm_code <> 0 THEN row_number() OVER (PARTITION BY {_KEYS}, run ORDER BY ts, event_id) ELSE 0 END AS alarm_streak
  FROM g WINDOW w AS (PARTITION BY {_KEYS} ORDER BY ts, event_id))
  SELECT event_id, CAST(alarm_streak AS BIGINT) AS alarm_streak, {', '.join(f'{R(c)} AS {c}' for c in ROLLED)} FROM h
  WHERE epoch_us(ts) // 1000 < (SELECT max(epoch_us(ts)) // 1000 FROM td) - 3600000""", ("td",))
def stream_features(spark, folder):
    """The rolling features of a stream over several micro-batches; the last hour still waits for late readings."""
    rows = b.few_devices(spark, folder, b.event_stream(spark, folder, _scratch(spark)))
    with _state_store(spark):
        made = _drained(rolling.rolling_features(rows, ts="ts", tie="event_id", late="1 hour"))
    return made.select("event_id", F.col("alarm_streak").cast("bigint"), *rounded(*ROLLED))
