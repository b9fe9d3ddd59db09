"""Queries over telemetry: rolling features, lags, streaks, labels and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sunloom import config
from sunloom.functions.grading import alert_message, alert_type, fault_text
from sunloom.functions.timeparts import time_encodings
from sunloom.operators import anomaly, features, labels, series
from sunloom.plans.registry import query, r, rounded
from sunloom.plans.views import r as R
from sunloom.sources import bindings

KEYS = config.SERIES_KEYS
FRAMES, LAGS = config.FRAMES, config.LAGS
DAY, AHEAD = FRAMES["24h"], config.LOOKAHEAD_ROWS
BACK = f"ROWS BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW"
ORDER = ["ts", "event_id"]
W = "PARTITION BY plant_id, mac, inverter_id ORDER BY ts, event_id"


def _series_step(df: DataFrame, step, behind: int = 0, ahead: int = 0, hot=series.MEASURE) -> DataFrame:
    return series.over_series(df, KEYS, "ts", "event_id", step, behind, ahead, hot=hot)


def _rolled(spark: SparkSession, folder: str, extremes: str | None, signals: list[str]) -> DataFrame:
    tv = bindings.few_devices(spark, folder).select(*KEYS, "ts", "event_id", *signals)
    return _series_step(tv, lambda f, p: features.rolling(f, p, ORDER, signals, FRAMES, extremes), behind=DAY)


SIGNALS = config.ROLLING_SIGNALS


@query(f"""SELECT event_id, {', '.join(f"{R(f'avg({s}) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)')} AS {s}_rmean_{l}"
       for l, n in FRAMES.items() for s in SIGNALS)} FROM td WINDOW w AS ({W})""", ("td",))
def roll_mean(spark, folder):
    names = [f"{s}_rmean_{l}" for l in FRAMES for s in SIGNALS]
    return _rolled(spark, folder, None, SIGNALS).select("event_id", *rounded(*names))


@query(f"""SELECT event_id, {', '.join(f"{R(f'coalesce(stddev_samp({s}) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0)')} AS {s}_rstd_{l}"
       for l, n in FRAMES.items() for s in SIGNALS)} FROM td WINDOW w AS ({W})""", ("td",))
def roll_std(spark, folder):
    names = [f"{s}_rstd_{l}" for l in FRAMES for s in SIGNALS]
    return _rolled(spark, folder, None, SIGNALS).select("event_id", *rounded(*names))


@query(f"""SELECT event_id, {', '.join(f"{R(f'{g}({s}) OVER (w {BACK})')} AS {s}_r{g}_24h"
       for g in ('min', 'max') for s in SIGNALS)} FROM td WINDOW w AS ({W})""", ("td",))
def roll_minmax(spark, folder):
    names = [f"{s}_r{g}_24h" for g in ("min", "max") for s in SIGNALS]
    tv = bindings.few_devices(spark, folder).select(*KEYS, "ts", "event_id", *SIGNALS)
    rolled = _series_step(tv, lambda f, p: features.rolling(f, p, ORDER, SIGNALS, {"24h": DAY}, "24h"), behind=DAY)
    return rolled.select("event_id", *rounded(*names))


@query(f"""SELECT event_id, {R('CASE WHEN m > 0 THEN s / m ELSE 0 END')} AS power_variability FROM (SELECT event_id,
  avg(power) OVER (w {BACK}) AS m, coalesce(stddev_samp(power) OVER (w {BACK}), 0) AS s FROM td WINDOW w AS ({W}))""", ("td",))
def power_variability(spark, folder):
    tv = bindings.few_devices(spark, folder).select(*KEYS, "ts", "event_id", "power")
    rolled = _series_step(tv, lambda f, p: features.rolling(f, p, ORDER, ["power"], {"24h": DAY}, None), behind=DAY)
    return rolled.select("event_id", r(features.row_kpis(rolled)["power_variability"]).alias("power_variability"))


@query(f"""SELECT event_id, last_value(kwh_total IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS kwh_total,
  last_value(limit_percent IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS limit_percent FROM tv WINDOW w AS ({W})""",
       ("tv",))
def ffill(spark, folder):
    tv = bindings.telemetry(spark, folder).select(*KEYS, "ts", "event_id", "kwh_total", "limit_percent")
    return series.fill_forward(tv, KEYS, "ts", "event_id", ["kwh_total", "limit_percent"]).select(
        "event_id", "kwh_total", "limit_percent")


@query(f"""SELECT event_id, {R("greatest(coalesce(c - lag(c) OVER w, 0), 0)")} AS kwh_delta FROM
  (SELECT *, coalesce(kwh_total, 0) AS c FROM tv) WINDOW w AS ({W})""", ("tv",))
def counter_delta(spark, folder):
    tv = bindings.telemetry(spark, folder).fillna(0, subset=["kwh_total"])
    stepped = _series_step(tv, lambda f, p: f.withColumn("d", features.counter_step(p, ORDER)), behind=1)
    return stepped.select("event_id", r("d").alias("kwh_delta"))


@query(f"""SELECT event_id, {', '.join(f"{R(f'coalesce(lag({s}, {n}) OVER w, 0)')} AS {s}_lag_{l}"
       for l, n in LAGS.items() for s in ("power", "temp", "string_imbalance"))}
  FROM (SELECT *, greatest(pv1_current, pv2_current, pv3_current) - least(pv1_current, pv2_current, pv3_current)
  AS string_imbalance FROM td) WINDOW w AS ({W})""", ("td",))
def lag_features(spark, folder):
    signals = ["power", "temp", "string_imbalance"]
    tv = bindings.few_devices(spark, folder)
    tv = tv.withColumn("string_imbalance", features.string_imbalance(tv))
    lagged = _series_step(tv, lambda f, p: f.withColumns(features.lags(f, p, ORDER, signals, LAGS)), behind=max(LAGS.values()))
    return lagged.select("event_id", *rounded(*[f"{s}_lag_{l}" for l in LAGS for s in signals]))


@query(f"""SELECT event_id, alarm_active, CAST(alarm_active * row_number() OVER (PARTITION BY plant_id, mac, inverter_id, run
  ORDER BY ts, event_id) AS BIGINT) AS alarm_streak FROM (SELECT *, sum(changed) OVER (w ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, CASE WHEN alarm_active = lag(alarm_active) OVER w THEN 0 ELSE 1 END AS changed
  FROM (SELECT *, CAST(alarm_code <> 0 AS INT) AS alarm_active FROM tv) WINDOW w AS ({W})) WINDOW w AS ({W}))""", ("tv",))
def alarm_streak(spark, folder):
    tv = bindings.telemetry(spark, folder).select(*KEYS, "ts", "event_id", "alarm_code")
    tv = tv.withColumn("alarm_active", features.state_flags(tv)["alarm_active"])
    return features.alarm_streak(tv, KEYS, "ts", "event_id").select(
        "event_id", "alarm_active", F.col("alarm_streak").cast("bigint"))


FLAGGED = f"""SELECT *, CAST(coalesce(alarm_code IN (464, 534, 548, 549, 557, 558, 559, 563, 581), false) AS INT) AS shutdown,
  CAST(hour(ts) >= 6 AND hour(ts) < 18 AND (op_state NOT IN (0, 5120) OR alarm_code IN (8, 10, 39)
   OR (usual > 100 AND (usual - power) / usual > 0.3::DOUBLE))
   AND NOT alarm_code IN (464, 534, 548, 549, 557, 558, 559, 563, 581) AS INT) AS degraded
  FROM (SELECT *, avg(power) OVER (w {BACK}) AS usual FROM td WINDOW w AS ({W}))"""


def _coded(spark, folder) -> DataFrame:
    return bindings.few_devices(spark, folder).select(*KEYS, "ts", "event_id", "power", "alarm_code", "op_state")


def _marked(tv: DataFrame, hot=series.MEASURE) -> DataFrame:
    rolled = _series_step(tv, lambda f, p: features.rolling(f, p, ORDER, ["power"], {"24h": DAY}, None), behind=DAY, hot=hot)
    return rolled.withColumn("is_daytime", time_encodings(F.col("ts"))["is_daytime"])


@query(f"SELECT event_id, shutdown AS shutdown_event, degraded AS degradation_event FROM ({FLAGGED})", ("td",))
def event_indicators(spark, folder):
    marked = _marked(_coded(spark, folder))
    return marked.withColumns(labels.events(marked)).select("event_id", "shutdown_event", "degradation_event")


LABELLED = f"""SELECT *, CASE WHEN max(shutdown) OVER (w ROWS BETWEEN CURRENT ROW AND {AHEAD - 1} FOLLOWING) >= 1 THEN 2
  WHEN max(degraded) OVER (w ROWS BETWEEN CURRENT ROW AND {AHEAD - 1} FOLLOWING) >= 1 THEN 1 ELSE 0 END AS risk_label
  FROM ({FLAGGED}) WINDOW w AS ({W})"""


def _labelled(spark, folder) -> DataFrame:
    def chain(frame, hot):
        return labels.add_labels(_marked(frame, hot), KEYS, "ts", "event_id", hot=hot)

    return series.chained(_coded(spark, folder), KEYS, chain)


@query(f"SELECT event_id, risk_label FROM ({LABELLED})", ("td",))
def lookahead_label(spark, folder):
    return _labelled(spark, folder).select("event_id", "risk_label")


@query(f"""SELECT plant_id, risk_label, count(*) AS n, {R('count(*) * 100e0 / sum(count(*)) OVER (PARTITION BY plant_id)')} AS share
  FROM ({LABELLED}) GROUP BY plant_id, risk_label""", ("td",))
def label_distribution(spark, folder):
    return labels.label_shares(_labelled(spark, folder), ["plant_id"]).select(
        "plant_id", "risk_label", "n", r("share").alias("share"))


def _z(c):
    m = f"avg({c}) OVER (w {BACK})"
    s = f"coalesce(stddev_samp({c}) OVER (w {BACK}), 1)"
    return f"abs(({c} - {m}) / CASE WHEN {s} = 0 THEN 1 ELSE {s} END)"


@query(f"""SELECT event_id, {R('zp')} AS power_zscore, {R('zt')} AS temp_zscore, CAST(zp > 3 AS INT) AS power_zscore_flag,
  CAST(zt > 3 AS INT) AS temp_zscore_flag, CAST(zp > 3 OR zt > 3 AS INT) AS zscore_anomaly
  FROM (SELECT event_id, {_z('power')} AS zp, {_z('temp')} AS zt FROM td WINDOW w AS ({W}))""", ("td",))
def zscore_flags(spark, folder):
    tv = bindings.few_devices(spark, folder).select(*KEYS, "ts", "event_id", "power", "temp")
    rolled = _series_step(tv, lambda f, p: features.rolling(f, p, ORDER, ["power", "temp"], {"24h": DAY}, None), behind=DAY)
    return anomaly.add_zscores(rolled, "24h").select(
        "event_id", *rounded("power_zscore", "temp_zscore"), "power_zscore_flag", "temp_zscore_flag", "zscore_anomaly")


@query(f"""SELECT event_id, {R('sin(2 * pi() * (hour(ts) + minute(ts) / 60e0) / 24)')} AS hour_sin,
  {R('cos(2 * pi() * (hour(ts) + minute(ts) / 60e0) / 24)')} AS hour_cos, {R('sin(2 * pi() * (isodow(ts) - 1) / 7)')} AS dow_sin,
  {R('cos(2 * pi() * (isodow(ts) - 1) / 7)')} AS dow_cos, CAST(hour(ts) >= 6 AND hour(ts) < 18 AS INT) AS is_daytime FROM tv""",
       ("tv",))
def time_encoding(spark, folder):
    tv = bindings.telemetry(spark, folder).select("event_id", "ts")
    return tv.withColumns(time_encodings(F.col("ts"))).select(
        "event_id", *rounded("hour_sin", "hour_cos", "dow_sin", "dow_cos"), "is_daytime")


@query(f"""SELECT event_id, greatest(pv1_current, pv2_current, pv3_current) - least(pv1_current, pv2_current, pv3_current)
  AS string_imbalance, abs(pv1_voltage - v_r) AS voltage_deviation, {R('power')} AS total_pv_power,
  CAST(alarm_code <> 0 AS INT) AS alarm_active, CAST(op_state = 5120 AS INT) AS is_running, CAST(op_state = 0 AS INT) AS is_off
  FROM tv""", ("tv",))
def row_kpis(spark, folder):
    tv = bindings.telemetry(spark, folder)
    kpis = {k: v for k, v in features.row_kpis(tv).items() if k != "power_variability"}
    return tv.withColumns({**kpis, **features.state_flags(tv)}).select(
        "event_id", "string_imbalance", "voltage_deviation", r("total_pv_power").alias("total_pv_power"),
        "alarm_active", "is_running", "is_off")


@query(f"""SELECT event_id, prev AS category_from, category AS category_to, kind AS type,
  CASE kind WHEN 'info' THEN concat('Performance warning: ', fault, ' on INV-', inverter_id)
  ELSE concat(fault, ' detected on INV-', inverter_id) END AS message FROM (SELECT *,
  CASE WHEN category = 'E' AND prev <> 'E' THEN 'critical' WHEN category = 'D' AND prev <> 'D' THEN 'warning'
   WHEN category = 'C' AND prev NOT IN ('C', 'D', 'E') THEN 'info' END AS kind,
  CASE category WHEN 'E' THEN CASE WHEN temp > 70 THEN 'Overheating — Thermal Shutdown Risk' ELSE 'Ground Fault — Insulation Failure' END
   WHEN 'D' THEN CASE WHEN pv1_current < 5 THEN 'String Degradation'
     WHEN alarm_code <> 0 THEN concat('Alarm Code ', alarm_code, ' — Operational Fault') ELSE 'String Degradation' END
   WHEN 'C' THEN CASE WHEN power < 5 THEN 'Low Power Output — String Issue'
     WHEN pv1_voltage < 32 THEN 'Partial Shading — Performance Loss'
     WHEN alarm_code <> 0 THEN concat('Communication Issue — Alarm Code ', alarm_code)
     ELSE 'Low Power Output — String Issue' END END AS fault
  FROM (SELECT *, lag(category, 1, 'A') OVER ({W}) AS prev FROM tv)) WHERE kind IS NOT NULL""", ("tv",))
def category_transitions(spark, folder):
    tv = bindings.telemetry(spark, folder)

    def step(frame, part):
        before = F.lag("category", 1, "A").over(Window.partitionBy(*part).orderBy(*ORDER))
        return frame.withColumn("category_from", before)

    moved = _series_step(tv, step, behind=1)
    fault = fault_text(F.col("category"), {"module_temp": F.col("temp"), "dc_current": F.col("pv1_current"),
                                           "dc_voltage": F.col("pv1_voltage"), "ac_power": F.col("power"),
                                           "alarm_code": F.col("alarm_code")})
    device = F.concat(F.lit("INV-"), F.col("inverter_id").cast("string"))
    kind = alert_type(F.col("category_from"), F.col("category"))
    return (moved.withColumn("type", kind).where(F.col("type").isNotNull())
            .select("event_id", "category_from", F.col("category").alias("category_to"), "type",
                    alert_message(F.col("type"), fault, device).alias("message")))


@query(f"""SELECT event_id, CAST(pos AS BIGINT) AS pos FROM (SELECT event_id, row_number() OVER ({W}) - 1 AS pos,
  count(*) OVER (PARTITION BY plant_id, mac, inverter_id) AS n FROM tv) WHERE pos % CAST(ceil(n / 30e0) AS BIGINT) = 0""", ("tv",))
def downsample(spark, folder):
    tv = bindings.telemetry(spark, folder).select(*KEYS, "ts", "event_id")
    return series.thin_out(tv, KEYS, "ts", "event_id", points=30).select("event_id", F.col("pos").cast("bigint"))




@query(f"""SELECT plant_id, risk_label, count(*) AS n, {R('avg(CASE WHEN m > 0 THEN s / m ELSE 0 END)', 3)} AS mean_variability,
  {R('max(m)', 3)} AS top_power_mean FROM (SELECT *, avg(power) OVER (w {BACK}) AS m,
  coalesce(stddev_samp(power) OVER (w {BACK}), 0) AS s FROM ({LABELLED}) WINDOW w AS ({W}))
  GROUP BY plant_id, risk_label""", ("td",))
def risk_profile(spark, folder):
    """Features to labels to a profile per plant: the whole telemetry chain in one plan."""
    def chain(frame, hot):
        return labels.add_labels(features.add_features(frame, KEYS, "ts", "event_id", hot=hot), KEYS, "ts", "event_id", hot=hot)

    labelled = series.chained(bindings.few_devices(spark, folder), KEYS, chain)
    return labelled.groupBy("plant_id", "risk_label").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("power_variability"), 3).alias("mean_variability"),
        r(F.max("power_rmean_24h"), 3).alias("top_power_mean"))
