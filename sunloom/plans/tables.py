"""Queries over sources and sinks: data goes through files in the shared folder and comes back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from sunloom import config
from sunloom.functions import texts
from sunloom.learning import attribution, scale
from sunloom.operators import clean, features, fleet, series
from sunloom.plans.learning import INPUTS, WEIGHTS, _mean, _scaler, _std
from sunloom.plans.registry import query, r
from sunloom.plans.views import r as R
from sunloom.session import shared_folder
from sunloom.sources import bindings as b
from sunloom.sources import ingest, stages


def _scratch(spark) -> str:
    return os.path.join(shared_folder(spark), f"tables-{uuid.uuid4().hex}")


@query(f"""SELECT plant_id, inverter_id, count(*) AS n, count(temp) AS n_temp, {R('sum(power)', 2)} AS power, {R('sum(string1)', 2)} AS string1
  FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'Plant 1' ELSE 'Plant 2' END AS plant_id, d AS inverter_id, CASE d WHEN 1 THEN power ELSE
  power / 2 END AS power, CASE WHEN d = 1 AND event_id % 2 = 0 THEN temp END AS temp, CASE WHEN event_id % 2 = 0 THEN pv2_current END
  AS string1 FROM tv, (VALUES (1), (2)) t(d)) GROUP BY ALL""", ("tv",))
def csv_ingest(spark, folder):
    """Telemetry written as wide CSV files of two plants with different columns, then ingested."""
    tv, root = b.telemetry(spark, folder), _scratch(spark)
    common = ["cast(unix_millis(ts) AS string) AS timestamp", "mac", "power AS `inverters[0].power`", "power / 2 AS `inverters[1].power`"]
    more = ["temp AS `inverters[0].temp`", "pv2_current AS `smu[0].string1`", "pv3_current AS `smu[1].string1`"]
    stages.write_csv(tv.where("event_id % 2 = 0").selectExpr(*common, *more), os.path.join(root, "Plant 1"))
    stages.write_csv(tv.where("event_id % 2 = 1").selectExpr(*common), os.path.join(root, "Plant 2"))
    return ingest.ingest(spark, root).groupBy("plant_id", "inverter_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("temp").alias("n_temp"), r(F.sum("power"), 2).alias("power"),
        r(F.sum("string1"), 2).alias("string1"))


@query("""SELECT inverter_id, category, 2 * count(*) AS n FROM rd GROUP BY ALL""", ("rd",))
def fact_append(spark, folder):
    """Scored readings appended twice to a fact table partitioned by grade, then read back."""
    path = os.path.join(_scratch(spark), "facts")
    rows = b.readings(spark, folder).select("inverter_id", "reading_id", "category")
    for _ in range(2):
        stages.append_rows(rows, path, ["category"])
    return spark.read.parquet(path).groupBy("inverter_id", "category").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT plant_id, count(*) AS n, min(event_id) AS first_id FROM tv GROUP BY plant_id""", ("tv",))
def stage_restart(spark, folder):
    """A stage stored as gzip parquet and the next step started from it."""
    root = _scratch(spark)
    stages.save_stage(b.telemetry(spark, folder), root, "ingest")
    return stages.load_stage(spark, root, "ingest").groupBy("plant_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("""SELECT conv_id, turn, role, CASE WHEN length(text) > 100 THEN 'long' ELSE 'short' END AS size FROM conversations""")
def chat_append(spark, folder):
    path = os.path.join(_scratch(spark), "chat")
    size = F.when(F.length("text") > 100, "long").otherwise("short")
    stages.append_rows(b.table(spark, folder, "conversations").withColumn("size", size), path)
    return spark.read.parquet(path).select("conv_id", "turn", "role", "size")


@query(f"""SELECT model, task, count(*) AS n, count(error) AS errors, {R('avg(latency_seconds)', 3)} AS latency FROM replies GROUP BY ALL""", ("replies",))
def study_results(spark, folder):
    """Replies written as nested JSON documents per model and exploded again."""
    path = os.path.join(_scratch(spark), "study")
    score = F.struct(F.lit(1.0).alias("score"))
    names = ["json_validity", "hallucination", "urgency_accuracy", "completeness", "response_quality"]
    rows = b.replies(spark, folder).select(
        "model", F.col("model").alias("display_name"), F.lit("local").alias("provider"), F.lit("m").alias("model_id"), "task",
        F.col("risk_class").alias("scenario_name"), "risk_class", "response", "latency_seconds", "input_tokens", "output_tokens", "error",
        F.struct(F.lit(1.0).alias("overall_score"), *[score.alias(n) for n in names]).alias("evaluation"))
    stages.write_results(rows, path)
    return stages.read_results(spark, path).groupBy("model", "task").agg(
        F.count(F.lit(1)).alias("n"), F.count("error").alias("errors"), r(F.avg("latency_seconds"), 3).alias("latency"))


@query("SELECT event_id, power FROM tv WHERE substr(md5(concat('42|', event_id)), 1, 8) < '33333333'", ("tv",))
def sampled_rows(spark, folder):
    """A seeded sample without replacement: rows whose hash falls below the share, whatever the file splits."""
    return b.telemetry(spark, folder).where(ingest.in_sample([F.col("event_id")], 0.2, 42)).select("event_id", "power")


@query(f"""SELECT DISTINCT k AS column_name FROM (SELECT j, unnest(json_keys(j)) AS k FROM (SELECT to_json(t) AS j FROM tv t))
  WHERE json_type(j, concat('$.', k)) IN ('DOUBLE', 'BIGINT', 'UBIGINT') AND k NOT IN ({", ".join(f"'{c}'" for c in config.NOT_FEATURES)})""", ("tv",))
def feature_names(spark, folder):
    """Numeric inputs that are neither keys nor metadata and hold a value."""
    tv = b.telemetry(spark, folder)
    names = clean.feature_columns(tv)
    held = tv.agg(*[F.count(n).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).alias("n")) for n in names])
    return held.select(F.inline(pairs)).where("n > 0").select("column_name")


@query(f"""SELECT feature, {R('avg(abs(z * w))')} AS importance FROM (SELECT unnest({INPUTS}) AS feature, unnest({WEIGHTS}::DOUBLE[]) AS w,
  unnest([{', '.join(f'({c} - {_mean(c)}) / {_std(c)}' for c in INPUTS)}]) AS z FROM tv) GROUP BY feature ORDER BY importance DESC, feature
  LIMIT 5""", ("tv",))
def top_features(spark, folder):
    rows = scale.scaled(b.telemetry(spark, folder).select("event_id", *INPUTS), _scaler(spark, folder, INPUTS), INPUTS)
    entries = rows.select(attribution.linear_entries(INPUTS, WEIGHTS).alias("entries"))
    return attribution.top_features(attribution.global_importance(entries)).select("feature", r("importance").alias("importance"))


@query(f"""SELECT row_number() OVER (ORDER BY importance DESC, feature) AS place, feature FROM (SELECT feature, avg(abs(z * w)) AS importance FROM (SELECT
  unnest({INPUTS}) AS feature, unnest({WEIGHTS}::DOUBLE[]) AS w, unnest([{', '.join(f'({c} - {_mean(c)}) / {_std(c)}' for c in INPUTS)}]) AS z FROM tv)
  GROUP BY feature) ORDER BY place LIMIT 5""", ("tv",))
def top_features_csv(spark, folder):
    """The five most important inputs, written as CSV with a header and read back in their order."""
    rows = scale.scaled(b.telemetry(spark, folder).select("event_id", *INPUTS), _scaler(spark, folder, INPUTS), INPUTS)
    entries = rows.select(attribution.linear_entries(INPUTS, WEIGHTS).alias("entries"))
    path = os.path.join(_scratch(spark), "top")
    stages.write_csv(attribution.top_features(attribution.global_importance(entries)).coalesce(1), path)
    back = spark.read.option("header", True).schema("feature string, importance double").csv(path)
    # five rows
    order = Window.orderBy(F.desc("importance"), "feature")
    return back.select(F.row_number().over(order).cast("bigint").alias("place"), "feature")


@query("""SELECT s_suppkey AS inverter_id, CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 THEN 'quarantined' ELSE 'loaded' END AS kind,
  CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 THEN s_suppkey * 1.5e0 END AS capacity_kw FROM supplier""")
def inverter_import(spark, folder):
    """Inverters loaded from CSV; lines that don't fit the schema are quarantined with their text."""
    path, key = os.path.join(_scratch(spark), "inverters"), F.col("s_suppkey")
    number = F.when(key % 7 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(key.cast("string"))
    capacity = F.when(key % 5 == 0, "n/a").otherwise((key * 1.5).cast("string"))
    stages.write_csv(b.table(spark, folder, "supplier").select(number.alias("inverter_id"), capacity.alias("capacity_kw")), path)
    good, bad = stages.read_quarantined(spark, path, "inverter_id bigint, capacity_kw double")
    found = F.coalesce("inverter_id", F.regexp_extract("_bad", "^x?([0-9]+)", 1).cast("bigint")).alias("inverter_id")
    return good.select("inverter_id", F.lit("loaded").alias("kind"), "capacity_kw").unionByName(
        bad.select(found, F.lit("quarantined").alias("kind"), F.lit(None).cast("double").alias("capacity_kw")))


@query(f"""SELECT user_role, action, count(*) AS n, {R('sum(amount)', 2)} AS amount FROM audit GROUP BY ALL""", ("audit",))
def audit_export(spark, folder):
    """The audit log exported as CSV with a header, then read back."""
    path = os.path.join(_scratch(spark), "audit")
    amount = F.get_json_object("details", "$.amount").cast("double").alias("amount")
    stages.write_csv(b.audit_logs(spark, folder).select("log_id", "user_role", "action", amount), path)
    back = spark.read.option("header", True).schema("log_id bigint, user_role string, action string, amount double").csv(path)
    return back.groupBy("user_role", "action").agg(F.count(F.lit(1)).alias("n"), r(F.sum("amount"), 2).alias("amount"))


@query("SELECT event_id, plant_id, power, temp FROM tv", ("tv",))
def drop_metadata(spark, folder):
    """Metadata columns go where they are present, whatever is left stays."""
    tv = b.telemetry(spark, folder).select("event_id", "plant_id", "power", "temp")
    noted = tv.withColumns({"_id": F.lit("x"), "createdAt": F.current_timestamp(), "__v": F.lit(1), "batteries": F.lit(None).cast("string")})
    return noted.drop(*config.DROPPED_COLUMNS)


@query(f"""SELECT event_id, {R('power')} AS total_pv_power, 0e0 AS voltage_deviation, 0e0 AS string_imbalance, 0e0 AS power_variability, 0 AS alarm_active,
  1 AS is_running, 0 AS is_off FROM tv""", ("tv",))
def default_columns(spark, folder):
    """KPIs and flags of plants that lack most signals: absent columns count as their defaults."""
    tv = b.telemetry(spark, folder).select("event_id", "power")
    made = tv.withColumns({**features.row_kpis(tv), **features.state_flags(tv)})
    return made.select("event_id", r("total_pv_power").alias("total_pv_power"), "voltage_deviation", "string_imbalance", "power_variability",
                       "alarm_active", "is_running", "is_off")


@query("""SELECT inverter_id, current_category, last_us FROM (SELECT i.inverter_id, current_category, epoch_us(m) AS last_us, CASE
  current_category WHEN 'offline' THEN 6 ELSE ascii(current_category) - 64 END AS severity FROM inverters i LEFT JOIN (SELECT inverter_id,
  max(ts) AS m FROM rd GROUP BY inverter_id) USING (inverter_id)) ORDER BY severity DESC, last_us DESC NULLS LAST, inverter_id""",
       ("inverters", "rd"))
def grid_order(spark, folder):
    """Worst grade first, then the latest data; the whole grid."""
    last = b.readings(spark, folder).groupBy("inverter_id").agg(F.max(F.unix_micros("ts")).alias("last_us"))
    rows = b.inverters(spark, folder).join(last, "inverter_id", "left")
    return fleet.grid(rows, "severity").select("inverter_id", "current_category", "last_us")


LAST_DATA = """SELECT inverter_id, epoch_us(m) AS last_us, row_number() OVER (ORDER BY {order}) AS place FROM inverters LEFT JOIN (SELECT
  inverter_id, max(ts) AS m FROM rd GROUP BY inverter_id) USING (inverter_id)"""


def _placed(spark, folder, order):
    """The whole grid with its places: rows are dealt into ranges of the order and numbered there."""
    last = b.readings(spark, folder).groupBy("inverter_id").agg(F.max(F.unix_micros("ts")).alias("last_us"))
    rows = b.inverters(spark, folder).select("inverter_id").join(last, "inverter_id", "left")
    numbered = series.numbered_by(series.ranged(rows, order, "grid"), [], F.col("__part"), order, "place")
    return numbered.select("inverter_id", "last_us", (F.col("place") + 1).cast("bigint").alias("place"))


@query(LAST_DATA.format(order="inverter_id"), ("inverters", "rd"))
def grid_by_id(spark, folder):
    return _placed(spark, folder, [F.col("inverter_id")])


@query(LAST_DATA.format(order="m DESC NULLS LAST, inverter_id"), ("inverters", "rd"))
def grid_by_update(spark, folder):
    return _placed(spark, folder, [F.desc_nulls_last("last_us"), F.col("inverter_id")])


@query("""SELECT inverter_id, type, n FROM (SELECT inverter_id, type, count(*) AS n FROM alerts WHERE NOT acknowledged GROUP BY ALL)
  WHERE type IN ('critical', 'warning')""", ("alerts",))
def pending_alerts(spark, folder):
    wanted = fleet.all_of(~F.col("acknowledged"), F.col("type").isin("critical", "warning"))
    return b.alerts(spark, folder).where(wanted).groupBy("inverter_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT prediction_id, string_agg(concat(feature, '=', CAST(floor(raw * 100 + 0.4871e0) AS BIGINT)), ',' ORDER BY pos) AS head FROM raws
  WHERE pos <= 15 GROUP BY prediction_id""", ("raws",))
def first_raw_values(spark, folder):
    """The first fifteen raw values in their given order."""
    whole = F.transform(texts.first_raw(F.col("raw")), lambda e: F.concat(
        e["feature"], F.lit("="), F.floor(e["value"] * 100 + F.lit(0.4871)).cast("string")))
    return b.predictions(spark, folder).select("prediction_id", F.array_join(whole, ",").alias("head"))
