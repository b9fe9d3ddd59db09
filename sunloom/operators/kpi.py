"""Energy, carbon, loss and efficiency KPIs. One scan of the readings feeds every KPI."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom import config
from sunloom.functions.numeric import js_round, ratio, strict_greatest, strict_least


def recent(readings: DataFrame, as_of: Column, days: int, ts: str = "ts") -> DataFrame:
    """Rows of the last `days` days before the parameter `as_of`."""
    return readings.where(F.col(ts) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def kpi_parts(step_hours: float) -> list[Column]:
    """Partial sums over readings joined to device capacity, which add up over days and devices.

    Devices that the fleet does not know (no capacity) count for energy and loss only.
    """
    power, capacity = F.col("ac_power"), F.col("capacity_kw")
    produced = strict_greatest(power, F.lit(0.0))
    known = capacity.isNotNull()
    sunny = known & (F.col("irradiation") > 10)
    heat = (F.col("module_temp") - config.NOMINAL_TEMP) / (config.CRITICAL_TEMP - config.NOMINAL_TEMP)
    stress = strict_least(strict_greatest(heat, F.lit(0.0)), F.lit(1.0))
    possible = capacity * F.col("irradiation") / F.lit(1000.0)
    lost = strict_greatest(F.col("dc_voltage") * F.col("dc_current") * config.EFFICIENCY - power, F.lit(0.0))
    strain, use = stress * power / F.greatest(capacity, F.lit(1.0)), power / F.greatest(possible, F.lit(0.001))
    hot, used = known & (F.col("module_temp") > 0), sunny & (power >= 0)

    def total(value, when=None):
        return F.coalesce(F.sum(value if when is None else F.when(when, value)), F.lit(0.0))

    return [
        F.count(F.lit(1)).alias("n_readings"), F.count_if("is_faulty").alias("n_faulty"),
        total(produced * step_hours).alias("energy_kwh"),
        total(lost * step_hours, F.col("is_faulty")).alias("loss_kwh"),
        total(strain, hot).alias("tdi_sum"), F.count(F.when(hot, strain)).alias("tdi_n"),
        total(use, used).alias("sue_sum"), F.count(F.when(used, use)).alias("sue_n"),
        total(produced * step_hours, sunny).alias("actual_kwh"),
        total(possible * step_hours, sunny).alias("possible_kwh"),
    ]


def finished(sums: DataFrame) -> DataFrame:
    """The KPIs, unrounded, beside the sums of `kpi_parts`."""
    tonnes = F.col("energy_kwh") * config.EMISSION_KG / 1000
    terms = sums.withColumns({
        "vcoy": tonnes, "carbon_revenue_usd": tonnes * config.CREDIT_USD,
        "elf_usd": F.col("loss_kwh") * config.TARIFF_USD,
        "tdi": F.least(F.coalesce(ratio(F.col("tdi_sum"), F.col("tdi_n")), F.lit(0.0)), F.lit(1.0)),
        "sue": F.least(F.coalesce(ratio(F.col("sue_sum"), F.col("sue_n")), F.lit(0.0)), F.lit(1.0)),
        "ppr": F.least(F.col("actual_kwh") / F.when(F.col("possible_kwh") == 0, 1.0).otherwise(
            F.col("possible_kwh")), F.lit(1.0)),
        "faulty_share": F.col("n_faulty") / F.greatest("n_readings", F.lit(1)),
    })
    score = 0.5 * F.least(F.col("vcoy") / 100, F.lit(1.0)) + 0.3 * F.col("sue") - 0.2 * F.col("faulty_share")
    return terms.withColumn("eis", F.greatest(score, F.lit(0.0)))


def fleet_kpis(readings: DataFrame, inverters: DataFrame, as_of: Column, days: int = 30,
               step_hours: float = config.KPI_STEP_HOURS, by: list[str] | None = None) -> DataFrame:
    """All platform KPIs, unrounded, for the fleet or per group."""
    dim = inverters.select("inverter_id", F.coalesce("capacity_kw", F.lit(0.0)).alias("capacity_kw"),
                           *[c for c in by or [] if c not in readings.columns])
    facts = recent(readings, as_of, days).join(dim, "inverter_id", "left")
    return finished(facts.groupBy(*(by or [])).agg(*kpi_parts(step_hours)))


def displayed(kpis: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The figures as shown: two decimals for amounts, three for scores, whole percentages."""
    def score(name):
        return js_round(F.col(name), 3).alias(name)

    return kpis.select(
        *(by or []), js_round(F.col("vcoy"), 2).alias("vcoy_tonnes"),
        js_round(F.col("carbon_revenue_usd"), 2).alias("carbon_revenue_usd"),
        js_round(F.col("energy_kwh")).alias("energy_kwh_30d"), js_round(F.col("loss_kwh"), 2).alias("loss_kwh"),
        js_round(F.col("elf_usd"), 2).alias("revenue_loss_usd"), score("tdi"),
        js_round((1 - F.col("tdi")) * 100).alias("tdi_health_pct"), score("sue"),
        js_round(F.col("sue") * 100).alias("sue_pct"), score("ppr"), js_round(F.col("ppr") * 100).alias("ppr_pct"),
        score("eis"), js_round(F.col("eis") * 100).alias("eis_pct"))


def healthy_share(inverters: DataFrame) -> DataFrame:
    """Devices, faulty or offline devices and the healthy percentage (100 for an empty fleet)."""
    bad = F.count_if(F.col("current_category").isin("D", "E", "offline"))
    return inverters.agg(F.count(F.lit(1)).alias("total_inverters"), bad.alias("faulty_count")).withColumn(
        "healthy_pct", F.coalesce(ratio((F.col("total_inverters") - F.col("faulty_count")) * 100.0,
                                        F.col("total_inverters")), F.lit(100.0)))


def installed_capacity(inverters: DataFrame) -> DataFrame:
    """Capacity of the devices online; 0 becomes 1 so the ratios stay defined."""
    total = F.coalesce(F.sum(F.when(F.col("is_online"), F.col("capacity_kw"))), F.lit(0.0))
    return inverters.agg(F.when(total == 0, 1.0).otherwise(total).alias("installed_kw"))


def green_report(readings: DataFrame, inverters: DataFrame, as_of: Column,
                 step_hours: float = config.KPI_STEP_HOURS) -> DataFrame:
    """Performance ratio, utilisation, avoided CO2, credits and everyday equivalents over 30 days."""
    energy = recent(readings, as_of, 30).agg(F.coalesce(
        F.sum(strict_greatest(F.col("ac_power"), F.lit(0.0)) * step_hours), F.lit(0.0)).alias("energy"))
    one = energy.withColumn("installed_kw", installed_capacity(inverters).scalar())
    kwh, kw = F.col("energy"), F.col("installed_kw")
    co2 = kwh * config.GRID_EMISSION_TONNES
    return one.select(
        js_round(kwh).alias("energy_kwh_30d"), js_round(co2, 1).alias("co2_avoided_tonnes"),
        js_round(co2, 1).alias("carbon_credits"), js_round(co2 * config.MARKET_CREDIT_USD).alias("credit_value_usd"),
        js_round(F.least(kwh / (kw * 720) * 100, F.lit(100.0)), 1).alias("pr_percent"),
        js_round(F.least(kwh / (kw * 8760) * 100 * 12, F.lit(100.0)), 1).alias("cuf_percent"),
        js_round(co2 * config.TREES_PER_TONNE).alias("trees"),
        js_round(co2 / config.TONNES_PER_CAR).alias("cars_off_road"),
        js_round(kwh / config.KWH_PER_HOME).alias("homes_powered"))


def revenue_lost(readings: DataFrame, inverters: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Per device now graded D or E: hours since its first D/E reading of the window, capped, and the loss."""
    bad = ["D", "E"]
    since = (recent(readings, as_of, days).where(F.col("category").isin(bad))
             .groupBy("inverter_id").agg(F.min("ts").alias("fault_since")))
    hours = F.least((F.unix_micros(as_of) - F.unix_micros("fault_since")) / F.lit(3.6e9),
                    F.lit(float(config.FAULT_HOURS_CAP)))
    return (inverters.where(F.col("current_category").isin(bad)).join(since, "inverter_id")
            .withColumn("hours", hours)
            .withColumn("loss_inr", F.col("capacity_kw") * F.col("hours") * config.TARIFF_INR))
