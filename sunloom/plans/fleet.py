"""Queries over the fleet tables: status, joins, listings, alerts, KPIs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from sunloom.functions import grading, timeparts
from sunloom.functions.texts import has_text
from sunloom.operators import fleet, kpi, rollups, series
from sunloom.plans.registry import query, r
from sunloom.plans.views import r as R
from sunloom.session import shared_folder
from sunloom.sources import bindings as b

AS_OF = "(SELECT max(ts) FROM rd)"


def _as_of(readings):
    """The newest time as a literal: time filters against it reach the scan."""
    return F.lit(readings.agg(F.max("ts")).first()[0])


def _dims(spark, folder):
    return b.inverters(spark, folder), b.blocks(spark, folder), b.plants(spark, folder)


# ------------------------------------------------------------------ status
@query("""SELECT count(*) AS total, count_if(current_category IN ('A', 'B')) AS healthy,
  count_if(current_category = 'C') AS warning, count_if(current_category IN ('D', 'E')) AS critical,
  count_if(current_category = 'offline' OR NOT is_online) AS offline FROM inverters""", ("inverters",))
def fleet_status(spark, folder):
    return fleet.status_counts(b.inverters(spark, folder))


@query("""SELECT count_if(current_category = 'A') AS "A", count_if(current_category = 'B') AS "B",
  count_if(current_category = 'C') AS "C", count_if(current_category = 'D') AS "D", count_if(current_category = 'E') AS "E",
  count_if(current_category = 'offline') AS offline FROM inverters""", ("inverters",))
def category_pivot(spark, folder):
    return fleet.category_columns(b.inverters(spark, folder))


@query("""SELECT plant_id, count_if(current_category = 'A') AS "A", count_if(current_category = 'B') AS "B",
  count_if(current_category = 'C') AS "C", count_if(current_category = 'D') AS "D", count_if(current_category = 'E') AS "E",
  count_if(current_category = 'offline') AS offline FROM inverters JOIN blocks USING (block_id) GROUP BY plant_id""",
       ("inverters", "blocks"))
def category_by_plant(spark, folder):
    inv, blocks, _ = _dims(spark, folder)
    return fleet.category_columns(inv.join(blocks, "block_id"), ["plant_id"])


@query("""SELECT count(*) AS total_plants, count_if(status = 'active') AS active_plants FROM plants
  WHERE status <> 'decommissioned'""", ("plants",))
def active_plants(spark, folder):
    return b.plants(spark, folder).where(F.col("status") != "decommissioned").agg(
        F.count(F.lit(1)).alias("total_plants"), F.count_if(F.col("status") == "active").alias("active_plants"))


@query("""SELECT operator_id, count(*) AS total, count_if(current_category IN ('A', 'B')) AS healthy,
  count_if(current_category = 'C') AS warning, count_if(current_category IN ('D', 'E')) AS critical,
  count_if(current_category = 'offline' OR NOT is_online) AS offline
  FROM access JOIN blocks USING (plant_id) JOIN inverters USING (block_id) GROUP BY operator_id""",
       ("access", "blocks", "inverters"))
def operator_status(spark, folder):
    """Status per operator: counted per plant first, so access rows multiply five rows and not the fleet."""
    inv, blocks, _ = _dims(spark, folder)
    per_plant = fleet.status_counts(inv.join(blocks, "block_id"), ["plant_id"])
    names = ["total", "healthy", "warning", "critical", "offline"]
    return (b.plant_access(spark, folder).join(per_plant, "plant_id").groupBy("operator_id")
            .agg(*[F.sum(n).alias(n) for n in names]))


@query("""SELECT p.plant_id, p.plant_name, count(DISTINCT b.block_id) AS block_count,
  count(DISTINCT i.inverter_id) AS inverter_count, any_value(a.name) AS created_by_name FROM plants p
  LEFT JOIN blocks b ON b.plant_id = p.plant_id LEFT JOIN inverters i ON i.block_id = b.block_id
  LEFT JOIN admins a ON a.admin_id = p.created_by GROUP BY p.plant_id, p.plant_name""",
       ("plants", "blocks", "inverters", "admins"))
def plant_summary(spark, folder):
    inv, blocks, plants = _dims(spark, folder)
    return fleet.plant_summary(plants, blocks, inv, b.admins(spark, folder)).select(
        "plant_id", "plant_name", "block_count", "inverter_count", "created_by_name")


@query("""SELECT b.block_id, b.block_name, count(i.inverter_id) AS inverter_count FROM blocks b LEFT JOIN inverters i
  ON i.block_id = b.block_id GROUP BY b.block_id, b.block_name""", ("blocks", "inverters"))
def block_counts(spark, folder):
    inv, blocks, _ = _dims(spark, folder)
    return fleet.block_counts(blocks, inv).select("block_id", "block_name", "inverter_count")


@query("""SELECT p.plant_id, string_agg(concat(block_name, ':', n), '; ' ORDER BY block_name) AS blocks FROM plants p JOIN
  (SELECT b.plant_id, b.block_id, b.block_name, count(i.inverter_id) AS n FROM blocks b LEFT JOIN inverters i
   ON i.block_id = b.block_id GROUP BY ALL) c ON c.plant_id = p.plant_id WHERE status <> 'decommissioned' GROUP BY p.plant_id""",
       ("plants", "blocks", "inverters"))
def nested_plants(spark, folder):
    inv, blocks, plants = _dims(spark, folder)
    line = F.transform("blocks", lambda x: F.concat(x["block_name"], F.lit(":"), x["inverter_count"].cast("string")))
    return fleet.nested_plants(plants, blocks, inv).select("plant_id", F.array_join(line, "; ").alias("blocks"))


@query("""SELECT max(epoch_us(ts)) AS last_data, min(epoch_us(ts)) AS first_data,
  min(CASE WHEN is_faulty THEN epoch_us(ts) END) AS fault_since FROM rd""", ("rd",))
def data_bounds(spark, folder):
    t = F.unix_micros("ts")
    return b.readings(spark, folder).agg(F.max(t).alias("last_data"), F.min(t).alias("first_data"),
                                         F.min(F.when(F.col("is_faulty"), t)).alias("fault_since"))


@query("""SELECT count(*) AS pending, count_if(type = 'critical') AS pending_critical FROM alerts WHERE NOT acknowledged""",
       ("alerts",))
def alert_badges(spark, folder):
    return b.alerts(spark, folder).where(~F.col("acknowledged")).agg(
        F.count(F.lit(1)).alias("pending"), F.count_if(F.col("type") == "critical").alias("pending_critical"))


# ------------------------------------------------------------------ joins and listings
FEED = """SELECT a.*, i.inverter_name, b.block_name, p.plant_id, p.plant_name, o.name AS acknowledged_by_name FROM alerts a
  JOIN inverters i USING (inverter_id) JOIN blocks b ON b.block_id = i.block_id JOIN plants p ON p.plant_id = b.plant_id
  LEFT JOIN operators o ON o.operator_id = a.acknowledged_by"""
FEED_USES = ("alerts", "inverters", "blocks", "plants", "operators")


def _feed(spark, folder, **wanted):
    return fleet.alert_feed(b.alerts(spark, folder), *_dims(spark, folder), b.operators(spark, folder), **wanted)


@query(f"""SELECT plant_name, block_name, type, count(*) AS n, count(acknowledged_by_name) AS named,
  max(epoch_us(created_at)) AS last_at FROM ({FEED}) GROUP BY ALL""", FEED_USES)
def alerts_star(spark, folder):
    return _feed(spark, folder).groupBy("plant_name", "block_name", "type").agg(
        F.count(F.lit(1)).alias("n"), F.count("acknowledged_by_name").alias("named"),
        F.max(F.unix_micros("created_at")).alias("last_at"))


@query(f"""SELECT alert_id, inverter_name, block_name, plant_name, acknowledged_by_name, epoch_us(created_at) AS created_us
  FROM ({FEED}) WHERE plant_id = 1 AND type = 'critical' AND acknowledged""", FEED_USES)
def filtered_alerts(spark, folder):
    return _feed(spark, folder, plant_id=1, kind="critical", acknowledged=True).select(
        "alert_id", "inverter_name", "block_name", "plant_name", "acknowledged_by_name",
        F.unix_micros("created_at").alias("created_us"))


@query(f"""SELECT alert_id, type, weight, epoch_us(created_at) AS created_us FROM ({FEED})
  ORDER BY created_at DESC, alert_id, weight LIMIT 100 OFFSET 50""", FEED_USES)
def paged_alerts(spark, folder):
    listing = _feed(spark, folder)
    return fleet.page(listing, [F.desc("created_at"), F.col("alert_id"), F.col("weight")], limit=100, offset=50, cap=200).select(
        "alert_id", "type", "weight", F.unix_micros("created_at").alias("created_us"))


@query("""SELECT alert_id, type, weight, epoch_us(created_at) AS created_us FROM alerts
  ORDER BY created_at DESC, alert_id, weight LIMIT 10""", ("alerts",))
def recent_alerts(spark, folder):
    listing = b.alerts(spark, folder)
    return fleet.page(listing, [F.desc("created_at"), F.col("alert_id"), F.col("weight")], limit=10).select(
        "alert_id", "type", "weight", F.unix_micros("created_at").alias("created_us"))


@query("""SELECT inverter_id, reading_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY inverter_id
  ORDER BY ts DESC, reading_id DESC) AS rn FROM rd WHERE is_faulty) WHERE rn <= 50""", ("rd",))
def fault_history(spark, folder):
    faults = b.readings(spark, folder).where("is_faulty")
    return fleet.top_per(faults, ["inverter_id"], [F.desc("ts"), F.desc("reading_id")], 50).select(
        "inverter_id", "reading_id", F.col("rank").cast("bigint").alias("rn"))


@query("""SELECT i.inverter_id, r.reading_id, r.category, r.dc_voltage, r.is_faulty, r.fault_type FROM inverters i LEFT JOIN
  (SELECT *, row_number() OVER (PARTITION BY inverter_id ORDER BY ts DESC, reading_id DESC) AS rn FROM rd) r
  ON r.inverter_id = i.inverter_id AND rn = 1""", ("inverters", "rd"))
def latest_row_number(spark, folder):
    newest = series.latest(b.readings(spark, folder), ["inverter_id"], "ts", "reading_id")
    return b.inverters(spark, folder).join(newest, "inverter_id", "left").select(
        "inverter_id", "reading_id", "category", "dc_voltage", "is_faulty", "fault_type")


@query("""SELECT i.inverter_id, r.reading_id FROM inverters i LEFT JOIN (SELECT r.* FROM rh r JOIN (SELECT inverter_id,
  max(hr) AS hr FROM rh GROUP BY inverter_id) m ON m.inverter_id = r.inverter_id AND m.hr = r.hr) r
  ON r.inverter_id = i.inverter_id""".replace("rh", "(SELECT *, date_trunc('day', ts) AS hr FROM rd)"),
       ("inverters", "rd"))
def latest_ties(spark, folder):
    """Readings of each device's newest day: all of them share the newest time and all stay."""
    daily = b.readings(spark, folder).select("inverter_id", "reading_id", F.date_trunc("day", "ts").alias("day"))
    return b.inverters(spark, folder).join(series.latest_with_ties(daily, ["inverter_id"], "day"),
                                           "inverter_id", "left").select("inverter_id", "reading_id")


@query("""SELECT l.log_id, l.action, l.user_role, coalesce(a.name, o.name) AS user_name, l.amount FROM audit l
  LEFT JOIN admins a ON l.user_id = a.admin_id AND l.user_role = 'admin'
  LEFT JOIN operators o ON l.user_id = o.operator_id AND l.user_role = 'operator'
  WHERE lower(l.action) LIKE '%urg%' OR l.action LIKE '%HIGH%'""", ("audit", "admins", "operators"))
def audit_polymorphic(spark, folder):
    logs = b.audit_logs(spark, folder).where(has_text(F.col("action"), "URG") | F.col("action").like("%HIGH%"))
    details = F.from_json("details", "amount double")
    return fleet.named_audit(logs, b.admins(spark, folder), b.operators(spark, folder)).select(
        "log_id", "action", "user_role", "user_name", details["amount"].alias("amount"))


@query("""SELECT o.operator_id, o.name, string_agg(p.plant_name, ', ' ORDER BY p.plant_name) AS plant_names,
  string_agg(CAST(p.plant_id AS VARCHAR), ',' ORDER BY p.plant_id) AS plant_ids FROM operators o
  LEFT JOIN access a ON a.operator_id = o.operator_id LEFT JOIN plants p ON p.plant_id = a.plant_id
  GROUP BY o.operator_id, o.name""", ("operators", "access", "plants"))
def operator_access_agg(spark, folder):
    return fleet.operator_directory(b.operators(spark, folder), b.plant_access(spark, folder),
                                    b.plants(spark, folder)).select("operator_id", "name", "plant_names", "plant_ids")


@query("""SELECT id, name, role, CAST(is_active AS VARCHAR) AS is_active, assigned_plants FROM (SELECT o.operator_id AS id, o.name, 'operator' AS role,
  o.is_active, string_agg(CAST(a.plant_id AS VARCHAR), ',' ORDER BY a.plant_id) AS assigned_plants FROM operators o
  LEFT JOIN access a USING (operator_id) GROUP BY ALL UNION ALL SELECT admin_id, name, 'admin', NULL, NULL FROM admins)""",
       ("operators", "access", "admins"))
def principal_directory(spark, folder):
    return fleet.principals(b.admins(spark, folder), b.operators(spark, folder), b.plant_access(spark, folder)).withColumn(
        "is_active", F.col("is_active").cast("string"))


@query("""SELECT i.inverter_id, b.plant_id FROM inverters i JOIN blocks b USING (block_id) WHERE b.plant_id IN
  (SELECT plant_id FROM access JOIN operators USING (operator_id) WHERE is_active AND operator_id % 50 = 7)""",
       ("inverters", "blocks", "access", "operators"))
def scoped_semi_join(spark, folder):
    inv, blocks, _ = _dims(spark, folder)
    team = b.operators(spark, folder).where(F.col("is_active") & (F.col("operator_id") % 50 == 7))
    access = b.plant_access(spark, folder).join(team, "operator_id", "left_semi")
    return fleet.scoped(inv.join(blocks, "block_id"), access).select("inverter_id", "plant_id")


@query("""SELECT inverter_id, plant_id FROM inverters JOIN blocks USING (block_id) WHERE plant_id IN (0, 2)""",
       ("inverters", "blocks"))
def scoped_in_list(spark, folder):
    inv, blocks, _ = _dims(spark, folder)
    return inv.join(blocks, "block_id").where(F.col("plant_id").isin(0, 2)).select("inverter_id", "plant_id")


@query("""SELECT inverter_id, current_category FROM inverters WHERE current_category IN ('D', 'E')
  ORDER BY current_category DESC, inverter_id LIMIT 20""", ("inverters",))
def needs_attention(spark, folder):
    return fleet.needs_attention(b.inverters(spark, folder)).select("inverter_id", "current_category")


@query("""SELECT i.inverter_id, i.inverter_name, b.block_name, p.plant_name, r.reading_id AS last_reading, a.alert_id AS last_alert
  FROM inverters i JOIN blocks b USING (block_id) JOIN plants p ON p.plant_id = b.plant_id
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY inverter_id ORDER BY ts DESC, reading_id DESC) AS rn FROM rd) r
   ON r.inverter_id = i.inverter_id AND r.rn = 1
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY inverter_id ORDER BY created_at DESC, alert_id DESC) AS rn FROM alerts) a
   ON a.inverter_id = i.inverter_id AND a.rn = 1""", ("inverters", "blocks", "plants", "rd", "alerts"))
def inverter_detail(spark, folder):
    inv, blocks, plants = _dims(spark, folder)
    read = series.latest(b.readings(spark, folder).select("inverter_id", "ts", "reading_id"), ["inverter_id"], "ts", "reading_id")
    alert = series.latest(b.alerts(spark, folder).select("inverter_id", "created_at", "alert_id"), ["inverter_id"],
                          "created_at", "alert_id")
    return (inv.join(blocks, "block_id").join(plants, "plant_id").join(read, "inverter_id", "left")
            .join(alert, "inverter_id", "left")
            .select("inverter_id", "inverter_name", "block_name", "plant_name",
                    F.col("reading_id").alias("last_reading"), F.col("alert_id").alias("last_alert")))


@query("""SELECT inverter_id, CASE WHEN current_category = 'offline' OR NOT is_online THEN 'offline'
  WHEN current_category IN ('A', 'B') THEN 'healthy' WHEN current_category = 'C' THEN 'warning' ELSE 'critical' END AS bucket,
  CASE current_category WHEN 'offline' THEN 6 ELSE ascii(current_category) - 64 END AS severity FROM inverters""",
       ("inverters",))
def health_buckets(spark, folder):
    c = F.col("current_category")
    return b.inverters(spark, folder).select("inverter_id", grading.health_bucket(c, F.col("is_online")).alias("bucket"),
                                             grading.category_order(c).cast("int").alias("severity"))


@query("""SELECT inverter_id, inverter_name FROM inverters JOIN blocks USING (block_id)
  WHERE contains(lower(inverter_name), '7') OR contains(lower(block_name), 'nation_1')""", ("inverters", "blocks"))
def name_search(spark, folder):
    inv, blocks, _ = _dims(spark, folder)
    return inv.join(blocks, "block_id").where(
        has_text(F.col("inverter_name"), "7") | has_text(F.col("block_name"), "Nation_1")).select("inverter_id", "inverter_name")


@query(f"""SELECT reading_id, category, confidence FROM rd WHERE ts >= {AS_OF} - INTERVAL 48 HOUR""", ("rd",))
def lookback_readings(spark, folder):
    rd = b.readings(spark, folder)
    return rd.where(F.col("ts") >= _as_of(rd) - F.expr("INTERVAL 48 HOURS")).select("reading_id", "category", "confidence")


@query("""SELECT reading_id, band FROM (SELECT reading_id, confidence * 100 AS c FROM rd) LEFT JOIN (VALUES ('A', 90, 100),
  ('B', 75, 89), ('C', 50, 74), ('D', 25, 49), ('E', 0, 24)) t(band, low, high) ON c BETWEEN low AND high""", ("rd",))
def band_range_join(spark, folder):
    return fleet.banded(b.readings(spark, folder), F.col("confidence") * 100).select("reading_id", "band")


# ------------------------------------------------------------------ KPIs
WINDOWED = f"(SELECT r.*, i.capacity_kw FROM rd r LEFT JOIN inverters i USING (inverter_id) WHERE ts >= {AS_OF} - INTERVAL 30 DAY)"
STEP = "(5 / 3600e0)"


def _kpis(spark, folder, by=None):
    rd = b.readings(spark, folder)
    return kpi.fleet_kpis(rd, b.inverters(spark, folder), _as_of(rd), by=by)


VCOY = f"""SELECT {R(f'sum(greatest(ac_power, 0)) * {STEP} * 0.71e0 / 1000')} AS vcoy,
  {R(f'sum(greatest(ac_power, 0)) * {STEP}', 3)} AS energy_kwh, {R(f'sum(greatest(ac_power, 0)) * {STEP} * 0.71e0 / 1000 * 40', 3)}
  AS carbon_revenue_usd FROM {WINDOWED}"""


@query(VCOY, ("rd", "inverters"))
def kpi_vcoy(spark, folder):
    return _kpis(spark, folder).select(r("vcoy").alias("vcoy"), r("energy_kwh", 3).alias("energy_kwh"),
                                       r("carbon_revenue_usd", 3).alias("carbon_revenue_usd"))


ELF = f"""SELECT {R(f'sum(greatest(dc_voltage * dc_current * 0.96e0 - ac_power, 0)) * {STEP}', 3)} AS loss_kwh,
  {R(f'sum(greatest(dc_voltage * dc_current * 0.96e0 - ac_power, 0)) * {STEP} * 0.06e0', 3)} AS elf_usd
  FROM {WINDOWED} WHERE is_faulty"""


@query(ELF, ("rd", "inverters"))
def kpi_elf(spark, folder):
    return _kpis(spark, folder).select(r("loss_kwh", 3).alias("loss_kwh"), r("elf_usd", 3).alias("elf_usd"))


TDI = f"""SELECT {R('least(avg(least(greatest((module_temp - 45) / 20, 0), 1) * ac_power / greatest(capacity_kw, 1)), 1)')} AS tdi
  FROM {WINDOWED} WHERE capacity_kw IS NOT NULL AND module_temp > 0"""


@query(TDI, ("rd", "inverters"))
def kpi_tdi(spark, folder):
    return _kpis(spark, folder).select(r("tdi").alias("tdi"))


SUE = "least(avg(ac_power / greatest(capacity_kw * irradiation / 1000, 0.001e0)), 1)"


SUE_ROW = f"""SELECT {R(SUE)} AS sue FROM {WINDOWED} WHERE capacity_kw IS NOT NULL AND irradiation > 10 AND ac_power >= 0"""


@query(SUE_ROW, ("rd", "inverters"))
def kpi_sue(spark, folder):
    return _kpis(spark, folder).select(r("sue").alias("sue"))


@query(f"""SELECT plant_id, {R('least(sum(greatest(ac_power, 0)) / sum(x.capacity_kw * irradiation / 1000), 1)')} AS ppr
  FROM {WINDOWED} x JOIN inverters i USING (inverter_id) JOIN blocks USING (block_id) WHERE irradiation > 10 GROUP BY plant_id""",
       ("rd", "inverters", "blocks"))
def kpi_ppr(spark, folder):
    rd, inv = b.readings(spark, folder), b.inverters(spark, folder).join(b.blocks(spark, folder), "block_id")
    return (kpi.fleet_kpis(rd, inv, _as_of(rd), by=["plant_id"]).where(F.col("plant_id").isNotNull())
            .select("plant_id", r("ppr").alias("ppr")))


EIS = f"""SELECT {R('greatest(0.5e0 * least(v / 100, 1) + 0.3e0 * s - 0.2e0 * f, 0)')} AS eis, {R('f')} AS faulty_share FROM
  (SELECT sum(greatest(ac_power, 0)) * {STEP} * 0.71e0 / 1000 AS v, count_if(is_faulty) / count(*)::DOUBLE AS f FROM {WINDOWED}),
  (SELECT {SUE} AS s FROM {WINDOWED} WHERE capacity_kw IS NOT NULL AND irradiation > 10 AND ac_power >= 0)"""


@query(EIS, ("rd", "inverters"))
def kpi_eis(spark, folder):
    return _kpis(spark, folder).select(r("eis").alias("eis"), r("faulty_share").alias("faulty_share"))


@query(f"""SELECT * FROM ({VCOY}), ({ELF}), ({TDI}), ({SUE_ROW}), ({EIS})""", ("rd", "inverters"))
def kpi_rollup(spark, folder):
    """All KPIs of 30 days out of daily sums: readings come in three batches in order of time, then a batch of late ones."""
    rd = b.readings(spark, folder)
    late = F.col("reading_id") % 7 == 3
    table = rollups.Rollup(spark, os.path.join(shared_folder(spark), f"rollup-{uuid.uuid4().hex}"), b.inverters(spark, folder))
    day = F.dayofmonth("ts")
    for batch, wanted in enumerate((~late & (day <= 10), ~late & (day > 10) & (day <= 20), ~late & (day > 20), late)):
        table.append(rd.where(wanted), batch)
    return table.window(_as_of(rd)).select(
        r("vcoy").alias("vcoy"), r("energy_kwh", 3).alias("energy_kwh"),
        r("carbon_revenue_usd", 3).alias("carbon_revenue_usd"), r("loss_kwh", 3).alias("loss_kwh"), r("elf_usd", 3).alias("elf_usd"),
        r("tdi").alias("tdi"), r("sue").alias("sue"), r("eis").alias("eis"), r("faulty_share").alias("faulty_share"))


@query(f"""SELECT count(*) AS total_inverters, count_if(current_category IN ('D', 'E', 'offline')) AS faulty_count,
  {R("(count(*) - count_if(current_category IN ('D', 'E', 'offline'))) * 100e0 / count(*)")} AS healthy_pct FROM inverters""",
       ("inverters",))
def healthy_share(spark, folder):
    return kpi.healthy_share(b.inverters(spark, folder)).select("total_inverters", "faulty_count",
                                                                r("healthy_pct").alias("healthy_pct"))


def _js(x, p=0):
    return f"floor(({x}) * 1e{p} + 0.5e0) / 1e{p}"


@query(f"""SELECT {_js('e')} AS energy_kwh_30d, {_js('e * 0.000716e0', 1)} AS co2_avoided_tonnes,
  {_js('e * 0.000716e0', 1)} AS carbon_credits, {_js('e * 0.000716e0 * 22')} AS credit_value_usd,
  {_js('least(e / (kw * 720) * 100, 100)', 1)} AS pr_percent, {_js('least(e / (kw * 8760) * 100 * 12, 100)', 1)} AS cuf_percent,
  {_js('e * 0.000716e0 * 45.8e0')} AS trees, {_js('e * 0.000716e0 / 4.6e0')} AS cars_off_road, {_js('e / 877')} AS homes_powered
  FROM (SELECT sum(greatest(ac_power, 0)) * (1 / 12e0) AS e FROM rd WHERE ts >= {AS_OF} - INTERVAL 30 DAY),
  (SELECT coalesce(sum(capacity_kw) FILTER (is_online), 1) AS kw FROM inverters)""", ("rd", "inverters"))
def green_report(spark, folder):
    rd = b.readings(spark, folder)
    return kpi.green_report(rd, b.inverters(spark, folder), _as_of(rd), step_hours=1 / 12)


LOST = f"""SELECT i.inverter_id, i.inverter_name, capacity_kw, least((epoch_us({AS_OF}) - min(epoch_us(ts))) / 3.6e9, 168) AS h
  FROM inverters i JOIN rd r USING (inverter_id) WHERE i.current_category IN ('D', 'E') AND r.category IN ('D', 'E')
  AND ts >= {AS_OF} - INTERVAL 7 DAY GROUP BY ALL"""


@query(f"SELECT inverter_id, inverter_name, {R('h', 1)} AS hours, {R('capacity_kw * h * 4', 1)} AS loss_inr FROM ({LOST})",
       ("rd", "inverters"))
def revenue_lost(spark, folder):
    rd = b.readings(spark, folder)
    return kpi.revenue_lost(rd, b.inverters(spark, folder), _as_of(rd)).select(
        "inverter_id", "inverter_name", r("hours", 1).alias("hours"), r("loss_inr", 1).alias("loss_inr"))


@query(f"SELECT count(*) AS devices, {R('sum(capacity_kw * h * 4)', 1)} AS loss_inr FROM ({LOST})", ("rd", "inverters"))
def revenue_lost_total(spark, folder):
    rd = b.readings(spark, folder)
    return kpi.revenue_lost(rd, b.inverters(spark, folder), _as_of(rd)).agg(
        F.count(F.lit(1)).alias("devices"), r(F.sum("loss_inr"), 1).alias("loss_inr"))


@query(f"""SELECT {R('least(v / 200, 1) * 100')} AS vcoy_gauge, {R('least(l / 5000, 1) * 100')} AS elf_gauge FROM
  (SELECT sum(greatest(ac_power, 0)) * {STEP} * 0.71e0 / 1000 AS v, sum(CASE WHEN is_faulty THEN
   greatest(dc_voltage * dc_current * 0.96e0 - ac_power, 0) END) * {STEP} AS l FROM {WINDOWED})""", ("rd", "inverters"))
def gauge_percent(spark, folder):
    return _kpis(spark, folder).select(r(grading.gauge_percent(F.col("vcoy"), 200)).alias("vcoy_gauge"),
                                       r(grading.gauge_percent(F.col("loss_kwh"), 5000)).alias("elf_gauge"))


# ------------------------------------------------------------------ live state
@query(f"""SELECT i.inverter_id, epoch_us(m) AS last_us, coalesce(epoch_us({AS_OF}) - epoch_us(m) > 86400000000, true) AS is_stale
  FROM inverters i LEFT JOIN (SELECT inverter_id, max(ts) AS m FROM rd GROUP BY inverter_id) USING (inverter_id)""",
       ("rd", "inverters"))
def stale_inverters(spark, folder):
    rd = b.readings(spark, folder)
    return fleet.stale_devices(rd, b.inverters(spark, folder), _as_of(rd), minutes=1440).select(
        "inverter_id", F.unix_micros("last_data_at").alias("last_us"), "is_stale")


@query(f"""SELECT block_id, count(*) AS devices, bool_and(coalesce(epoch_us({AS_OF}) - epoch_us(m) > 86400000000, true)) AS all_stale
  FROM inverters i LEFT JOIN (SELECT inverter_id, max(ts) AS m FROM rd GROUP BY inverter_id) USING (inverter_id)
  GROUP BY block_id""", ("rd", "inverters"))
def block_offline(spark, folder):
    rd = b.readings(spark, folder)
    return fleet.silent_blocks(fleet.stale_devices(rd, b.inverters(spark, folder), _as_of(rd), minutes=1440))


@query("""SELECT inverter_id, reading_id, category FROM (SELECT *, row_number() OVER (PARTITION BY inverter_id
  ORDER BY ts DESC, reading_id DESC) AS rn FROM rd) WHERE rn = 1""", ("rd",))
def latest_wins_upsert(spark, folder):
    """Faulty readings arrive as changes to the stored healthy ones; the newest of both stays."""
    rd = b.readings(spark, folder).select("inverter_id", "ts", "reading_id", "category", "is_faulty")
    return fleet.upsert_latest(rd.where("not is_faulty"), rd.where("is_faulty"), ["inverter_id"], "ts", "reading_id").select(
        "inverter_id", "reading_id", "category")


@query(f"""SELECT inverter_id, CASE WHEN m IS NULL THEN 'Unknown' WHEN age < 1 THEN 'Just now' WHEN age < 60 THEN concat(age, ' min ago')
  ELSE concat(age // 60, 'h ', age % 60, 'm ago') END AS age FROM (SELECT i.inverter_id, m,
  (epoch_us({AS_OF}) - epoch_us(m)) // 60000000 AS age FROM inverters i LEFT JOIN (SELECT inverter_id, max(ts) AS m FROM rd
  GROUP BY inverter_id) USING (inverter_id))""", ("rd", "inverters"))
def age_text(spark, folder):
    rd = b.readings(spark, folder)
    as_of = _as_of(rd)
    return fleet.stale_devices(rd, b.inverters(spark, folder), as_of).select(
        "inverter_id", timeparts.age_text(F.col("last_data_at"), as_of).alias("age"))


@query("""SELECT reading_id, is_faulty, category <> 'offline' AND op_state <> 0 AS online FROM rd""", ("rd",))
def reading_flags(spark, folder):
    return b.readings(spark, folder).select(
        "reading_id", grading.is_faulty(F.col("category")).alias("is_faulty"),
        grading.is_online(F.col("category"), F.col("op_state")).alias("online"))


@query("""SELECT inverter_id, reading_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY inverter_id ORDER BY ts DESC,
  reading_id DESC) AS rn FROM rd) WHERE rn <= 10""", ("rd",))
def recent_log(spark, folder):
    return fleet.top_per(b.readings(spark, folder), ["inverter_id"], [F.desc("ts"), F.desc("reading_id")], 10).select(
        "inverter_id", "reading_id", F.col("rank").cast("bigint").alias("rn"))


@query("""SELECT count(*) AS processed, count_if(risk_score >= 0.8e0) AS critical,
  count_if(risk_score >= 0.4e0 AND risk_score < 0.8e0) AS warning FROM preds""", ("preds",))
def running_totals(spark, folder):
    band = grading.risk_band(F.col("risk_score"))
    return b.predictions(spark, folder).agg(F.count(F.lit(1)).alias("processed"), F.count_if(band == "critical").alias("critical"),
                                            F.count_if(band == "warning").alias("warning"))
