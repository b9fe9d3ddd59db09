"""Queries over ingest and cleaning steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from sunloom import config
from sunloom.functions import numeric
from sunloom.functions.texts import as_map, clean_id
from sunloom.operators import clean, quantiles
from sunloom.plans.registry import query, r
from sunloom.plans.views import r as R
from sunloom.sources import bindings as b
from sunloom.sources import ingest

SIGNALS = ["power", "temp", "pv1_current", "pv1_voltage", "alarm_code"]


def _q(column, p):
    return f"quantile_cont({column}::DOUBLE, {p})"


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", {R(_q(c, 0.25))} AS q1, {R(_q(c, 0.75))} AS q3,
  CASE WHEN {_q(c, 0.75)} <> {_q(c, 0.25)} THEN {R(f'{_q(c, 0.25)} - 3 * ({_q(c, 0.75)} - {_q(c, 0.25)})')} END AS low,
  CASE WHEN {_q(c, 0.75)} <> {_q(c, 0.25)} THEN {R(f'{_q(c, 0.75)} + 3 * ({_q(c, 0.75)} - {_q(c, 0.25)})')} END AS high
  FROM tv""" for c in SIGNALS), ("tv",))
def iqr_bounds(spark, folder):
    tv = b.telemetry(spark, folder)
    return quantiles.iqr_bounds(tv, SIGNALS, 3.0).select("column", *[r(c).alias(c) for c in ("q1", "q3", "low", "high")])


@query(f"""SELECT event_id, {', '.join(f"{R(f'CASE WHEN l_{c} IS NULL OR {c} IS NULL THEN {c} ELSE least(greatest({c}, l_{c}), h_{c}) END')} AS {c}"
       for c in ('power', 'temp', 'kwh_total'))} FROM tv, (SELECT
  {', '.join(f'CASE WHEN {_q(c, .75)} <> {_q(c, .25)} THEN {_q(c, .25)} - 0.2e0 * ({_q(c, .75)} - {_q(c, .25)}) END AS l_{c}, '
             f'{_q(c, .75)} + 0.2e0 * ({_q(c, .75)} - {_q(c, .25)}) AS h_{c}' for c in ('power', 'temp', 'kwh_total'))} FROM tv)""",
       ("tv",))
def winsorise(spark, folder):
    """A narrow factor so that many values are clipped; NULL counters stay NULL."""
    names = ["power", "temp", "kwh_total"]
    tv = b.telemetry(spark, folder).select("event_id", *names)
    return clean.winsorise(tv, names, factor=0.2).select("event_id", *[r(n).alias(n) for n in names])


@query("""SELECT DISTINCT user_id, event_type, k FROM (SELECT * FROM ek UNION ALL SELECT * FROM ek)""", ("ek",))
def dedupe_exact(spark, folder):
    events = b.table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    rows = events.select("user_id", "event_type", "k")
    return rows.unionByName(rows).dropDuplicates()


@query("""SELECT inverter_id, d AS "day", min(event_id) AS first_event FROM (SELECT *, CAST(ts AS DATE)::VARCHAR AS d FROM tv)
  GROUP BY inverter_id, d""", ("tv",))
def dedupe_keys(spark, folder):
    """One row per device and time key; the kept row is the earliest, so reruns agree."""
    tv = b.telemetry(spark, folder).select("inverter_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id")
    return tv.groupBy("inverter_id", "day").agg(F.min("event_id").alias("first_event"))


def _wide(spark, folder):
    return b.telemetry(spark, folder).select(
        "event_id", "mac", F.col("power").alias("inverters[0].power"), F.col("temp").alias("inverters[0].temp"),
        (F.col("power") / 2).alias("inverters[1].power"), F.col("pv1_current").alias("inverters[1].pv1_current"),
        F.col("pf").alias("meters[0].pf"), F.col("pv2_current").alias("smu[0].string1"),
        F.col("pv3_current").alias("smu[1].string1"))


@query(f"""SELECT event_id, mac, {R('pf')} AS pf, pv2_current AS string1, d AS inverter_id,
  {R('CASE d WHEN 1 THEN power ELSE power / 2 END')} AS power, CASE d WHEN 1 THEN {R('temp')} END AS temp,
  CASE d WHEN 2 THEN pv1_current END AS pv1_current FROM tv, (VALUES (1), (2)) t(d)""", ("tv",))
def melt_wide(spark, folder):
    """Two devices with different fields; of the two `string1` columns the first stays."""
    return ingest.melt(_wide(spark, folder)).select("event_id", "mac", r("pf").alias("pf"), "string1", "inverter_id",
                                                    r("power").alias("power"), r("temp").alias("temp"), "pv1_current")


@query("""SELECT count(k) AS k_present, count(TRY_CAST(k AS DOUBLE)) AS k_converted, count(event_type) AS t_present,
  count(TRY_CAST(event_type AS DOUBLE)) AS t_converted FROM (SELECT CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE
  json_extract_string(props, '$.k') END AS k, event_type FROM events)""")
def coerce_numeric(spark, folder):
    k = F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.get_json_object("props", "$.k"))
    rows = b.table(spark, folder, "events").select(k.alias("k"), "event_type")
    return ingest.numeric_shares(rows, ["k", "event_type"]).select(
        F.col("k.present").alias("k_present"), F.col("k.converted").alias("k_converted"),
        F.col("event_type.present").alias("t_present"), F.col("event_type.converted").alias("t_converted"))


@query("""SELECT event_id, epoch_us(t) AS us FROM (SELECT event_id, make_timestamp_ms(epoch_us(ts) // 1000 - (event_id % 7) * 86400000 * 2) AS t
  FROM events) WHERE t BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2026-01-01'""")
def sane_times(spark, folder):
    """Epoch milliseconds as text, some of them before the sane range."""
    shift = (F.col("event_id") % 7) * 86_400_000 * 2
    rows = b.table(spark, folder, "events").select(
        "event_id", (F.unix_millis("ts") - shift).cast("string").alias("timestamp"))
    return clean.parse_times(rows).select("event_id", F.unix_micros("timestamp").alias("us"))


@query("""SELECT event_id, kwh_total, limit_percent FROM tv WHERE kwh_total IS NOT NULL""", ("tv",))
def drop_null_keys(spark, folder):
    return b.telemetry(spark, folder).dropna(subset=["kwh_total"]).select("event_id", "kwh_total", "limit_percent")


@query("""SELECT event_id, coalesce(kwh_total, 0) AS kwh_total, coalesce(limit_percent, 0) AS limit_percent FROM tv""", ("tv",))
def fill_zero(spark, folder):
    return b.telemetry(spark, folder).select("event_id", "kwh_total", "limit_percent").fillna(0, ["kwh_total", "limit_percent"])


BROKEN = ("CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 0 ELSE x END")


@query(f"""SELECT event_id, {R(BROKEN)} AS x FROM (SELECT event_id, CASE WHEN k = 0 THEN 'NaN'::DOUBLE
  WHEN k = 1 THEN 'Infinity'::DOUBLE WHEN k = 2 THEN '-Infinity'::DOUBLE WHEN k = 3 THEN NULL ELSE value END AS x FROM ek)""",
       ("ek",))
def zero_bad_numbers(spark, folder):
    k = F.get_json_object("props", "$.k").cast("int")
    odd = (F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf"))
           .when(k == 3, F.lit(None)).otherwise(F.col("value")))
    return b.table(spark, folder, "events").select("event_id", r(numeric.zero_if_bad(odd)).alias("x"))


VOLTS, POWER, HEAT = ("dc_voltage * 3 NOT BETWEEN 0 AND 2000", "ac_power NOT BETWEEN 0 AND 500",
                      "module_temp + 90 NOT BETWEEN -40 AND 150")


@query(f"""SELECT reading_id, concat_ws(',', CASE WHEN {VOLTS} THEN 'dc_voltage' END, CASE WHEN {POWER} THEN 'ac_power' END,
  CASE WHEN {HEAT} THEN 'module_temp' END) AS broken FROM rd WHERE {VOLTS} OR {POWER} OR {HEAT}""", ("rd",))
def validate_ranges(spark, folder):
    """Readings scaled so that three rules are broken now and then; the quarantine side."""
    reading = {"dc_voltage": F.col("dc_voltage") * 3, "ac_power": F.col("ac_power"),
               "module_temp": F.col("module_temp") + 90, "irradiation": F.col("irradiation")}
    _, bad = clean.split_valid(b.readings(spark, folder), reading)
    return bad.select("reading_id", F.array_join("broken", ",").alias("broken"))


@query(f"""SELECT prediction_id, count(*) AS kept, {R('sum(weight)')} AS total FROM shap WHERE feature <> 'rolling_power_mean'
  GROUP BY prediction_id""", ("shap",))
def feature_allow_list(spark, folder):
    kept = clean.allowed_features(as_map(F.col("shap")))
    total = F.aggregate(F.map_values("kept"), F.lit(0.0), lambda a, x: a + x)
    return b.predictions(spark, folder).select("prediction_id", kept.alias("kept")).select(
        "prediction_id", F.size("kept").cast("bigint").alias("kept"), r(total).alias("total"))


@query(f"""SELECT reading_id, {R('dc_voltage')} AS pv1_voltage, {R('dc_current')} AS pv1_current, {R('ac_power')} AS power,
  {R('module_temp')} AS temp, {R('ambient_temp')} AS ambient_temp, {R('irradiation')} AS meter_active_power FROM rd""", ("rd",))
def rename_readings(spark, folder):
    named = b.readings(spark, folder).withColumnsRenamed(config.READING_TO_FEATURE)
    return named.select("reading_id", *[r(n).alias(n) for n in config.READING_TO_FEATURE.values()])


@query("""SELECT event_id AS id, 'event' AS kind, value, NULL AS text FROM events
  UNION ALL SELECT doc_id, 'document', NULL, lang FROM documents""")
def union_columns(spark, folder):
    left = b.table(spark, folder, "events").select(F.col("event_id").alias("id"), F.lit("event").alias("kind"), "value")
    right = b.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"),
                                                       F.col("lang").alias("text"))
    return left.unionByName(right, allowMissingColumns=True)


@query("""SELECT event_id, translate(trim(concat('  <', event_type, '&', user_id, '>  ')), '<>&', '') AS id FROM events""")
def clean_ids(spark, folder):
    raw = F.concat(F.lit("  <"), F.col("event_type"), F.lit("&"), F.col("user_id").cast("string"), F.lit(">  "))
    return b.table(spark, folder, "events").select("event_id", clean_id(raw).alias("id"))


@query("""SELECT event_id, floor(value + 0.5) AS js, floor(value * 10 + 0.5) / 10 AS js1,
  CASE WHEN event_id % 2 = 0 THEN NULL ELSE greatest(value, 50) END AS top,
  CASE WHEN event_id % 2 = 0 THEN NULL ELSE least(value, 50) END AS bottom, round_even(k / 10e0, 0) AS even FROM ek""", ("ek",))
def rounding_rules(spark, folder):
    """Browser rounding, half-even rounding and NULL-strict greatest / least."""
    v, half = F.col("value"), F.when(F.col("event_id") % 2 != 0, F.lit(50.0))
    k = F.get_json_object("props", "$.k").cast("int")
    return b.table(spark, folder, "events").select(
        "event_id", numeric.js_round(v).alias("js"), numeric.js_round(v, 1).alias("js1"),
        numeric.strict_greatest(v, half).alias("top"), numeric.strict_least(v, half).alias("bottom"),
        numeric.even_round(k / F.lit(10.0)).alias("even"))


@query("""SELECT idx, field, count(*) AS n FROM (SELECT regexp_extract(c, '^inverters\\[(\\d+)\\]\\.(.+)$', 1) AS idx,
  regexp_extract(c, '^inverters\\[(\\d+)\\]\\.(.+)$', 2) AS field FROM (SELECT concat('inverters[', user_id % 3, '].', event_type)
  AS c FROM events)) GROUP BY ALL""")
def parse_names(spark, folder):
    """Device index and field out of column names held as data."""
    name = F.concat(F.lit("inverters["), (F.col("user_id") % 3).cast("string"), F.lit("]."), F.col("event_type"))
    parts = [F.regexp_extract(name, r"^inverters\[(\d+)\]\.(.+)$", i) for i in (1, 2)]
    return (b.table(spark, folder, "events").select(parts[0].alias("idx"), parts[1].alias("field"))
            .groupBy("idx", "field").agg(F.count(F.lit(1)).alias("n")))
