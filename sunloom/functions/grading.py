"""Grades, fault texts, bands and ticket fields derived from a score."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from sunloom import config


def best_class(probabilities: Column) -> Column:
    """0-based index of the largest probability; the first one wins a tie."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def class_name(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in config.CLASS_NAMES]), index + 1)


def grade(index: Column, probabilities: Column) -> Column:
    """Letter grade A-E from the winning class and how sure it is."""
    sure = F.element_at(probabilities, index + 1)
    return (F.when(index == 2, "E")
            .when(index == 1, F.when(sure >= 0.70, "D").otherwise("C"))
            .otherwise(F.when(sure >= 0.90, "A").when(sure >= 0.70, "B").otherwise("C")))


def fault_text(category: Column, reading: dict[str, Column]) -> Column:
    """Fault wording by grade and reading; a missing reading takes the rule's default."""
    def value(name, default):
        column = reading.get(name)
        return F.lit(default) if column is None else F.coalesce(column, F.lit(default))

    alarm = value("alarm_code", 0).cast("int")
    # fixed values: the wording of each fault
    worst = (F.when(value("module_temp", 0) > 70, "Overheating — Thermal Shutdown Risk")
             .when(value("irradiation", 999) < 300, "Grid Fault — Frequency Deviation")
             .when((value("dc_voltage", 999) == 0) & (value("dc_current", 999) == 0), "Inverter Shutdown — Critical")
             .otherwise("Ground Fault — Insulation Failure"))
    serious = (F.when(value("dc_current", 10) < 5, "String Degradation")
               .when(alarm != 0, F.format_string("Alarm Code %d — Operational Fault", alarm))
               .otherwise("String Degradation"))
    minor = (F.when(value("ac_power", 10) < 5, "Low Power Output — String Issue")
             .when(value("dc_voltage", 40) < 32, "Partial Shading — Performance Loss")
             .when(alarm != 0, F.format_string("Communication Issue — Alarm Code %d", alarm))
             .otherwise("Low Power Output — String Issue"))
    return F.when(category == "E", worst).when(category == "D", serious).when(category == "C", minor)


def risk_class(predicted: Column) -> Column:
    """Known class names pass, anything else counts as no_risk."""
    known = F.create_map(*chain.from_iterable((F.lit(n), F.lit(n)) for n in config.CLASS_NAMES))
    return F.coalesce(F.try_element_at(known, F.coalesce(predicted, F.lit(""))), F.lit(config.CLASS_NAMES[0]))


def is_faulty(category: Column) -> Column:
    return category.isin("C", "D", "E")


def is_online(category: Column, op_state: Column) -> Column:
    return (category != "offline") & (F.coalesce(op_state, F.lit(config.RUNNING_STATE)) != config.OFF_STATE)


def health_bucket(category: Column, online: Column) -> Column:
    """One bucket per device for display; being offline outranks the grade."""
    return (F.when((category == "offline") | ~online, "offline").when(category.isin("A", "B"), "healthy")
            .when(category == "C", "warning").when(category.isin("D", "E"), "critical"))


def category_order(category: Column) -> Column:
    """Position of the grade in A < B < C < D < E < offline."""
    return F.array_position(F.array(*[F.lit(c) for c in config.CATEGORIES]), category)


def alert_type(before: Column, now: Column) -> Column:
    """Alert raised by a change of grade; NULL when none is."""
    return (F.when((now == "E") & (before != now), "critical").when((now == "D") & (before != now), "warning")
            .when((now == "C") & ~before.isin("C", "D", "E"), "info"))


def alert_message(kind: Column, fault: Column, device: Column) -> Column:
    return (F.when(kind == "info", F.concat(F.lit("Performance warning: "),
                                            F.coalesce(fault, F.lit("Minor deviation")), F.lit(" on "), device))
            .when(kind.isNotNull(), F.concat(F.coalesce(fault, F.lit("Fault")), F.lit(" detected on "), device)))


def risk_band(score: Column) -> Column:
    return F.when(score >= 0.8, "critical").when(score >= 0.4, "warning").otherwise("normal")


def ticket_priority(score: Column) -> Column:
    return F.when(score > 0.85, "P1-Critical").when(score > 0.6, "P2-High").otherwise("P3-Medium")


def ticket_id(ts: Column, *identity: Column) -> Column:
    """TKT-yyyyMMdd-XXXXXX; the tail is a hash of the identity, so reruns give the same ticket."""
    tail = F.upper(F.substring(F.sha2(F.concat_ws("|", *identity), 256), 1, 6))
    return F.concat(F.lit("TKT-"), F.date_format(ts, "yyyyMMdd"), F.lit("-"), tail)


def gauge_percent(value: Column, full_scale: float) -> Column:
    return F.least(value / F.lit(float(full_scale)), F.lit(1.0)) * 100
