"""Daily sums and sketches against the KPIs and quantiles of the whole table."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sunloom.operators import kpi, rollups
from sunloom.sources import bindings

NAMES = ["n_readings", "n_faulty", "energy_kwh", "loss_kwh", "vcoy", "carbon_revenue_usd", "elf_usd", "tdi", "sue", "ppr", "faulty_share", "eis"]


def test_window_equals_the_whole_table(spark, small, tmp_path):
    rd, inv = bindings.readings(spark, small).cache(), bindings.inverters(spark, small)
    table = rollups.Rollup(spark, str(tmp_path), inv)
    late = F.col("reading_id") % 5 == 0
    table.append(rd.where(~late), 0)
    table.append(rd.where(late), 1)
    table.append(rd.where(late), 1)  # the batch runs again after a failure
    table.append(rd.limit(0), 2)
    newest = rd.agg(F.max("ts")).first()[0]
    groups = inv.select("inverter_id", (F.col("inverter_id") % 3).alias("g"))
    for days in (3, 12, 30):
        as_of = F.lit(newest)
        got, want = table.window(as_of, days).first(), kpi.fleet_kpis(rd, inv, as_of, days).first()
        assert [got[n] for n in NAMES] == [pytest.approx(want[n], abs=1e-9) for n in NAMES], days
        per = {r["g"]: r for r in table.window(as_of, days, groups).collect()}
        for r in kpi.fleet_kpis(rd.join(groups, "inverter_id", "left"), inv, as_of, days, by=["g"]).collect():
            assert [per[r["g"]][n] for n in NAMES] == [pytest.approx(r[n], abs=1e-9) for n in NAMES]


def test_changed_days_only(spark, small, tmp_path):
    """A late batch of one day writes the sums of that day; a window reads days and the one day it cuts."""
    rd, inv = bindings.readings(spark, small).cache(), bindings.inverters(spark, small)
    table = rollups.Rollup(spark, str(tmp_path), inv)
    one = F.dayofmonth("ts") == 9
    table.append(rd.where(~one | (F.col("reading_id") % 2 == 0)), 0)

    def written():
        return {d: max(os.path.getmtime(os.path.join(table.days, d, f)) for f in os.listdir(os.path.join(table.days, d)))
                for d in os.listdir(table.days) if d.startswith("day=")}

    before = written()
    table.append(rd.where(one & (F.col("reading_id") % 2 == 1)), 1)
    after = written()
    assert {d for d in after if after[d] != before[d]} == {"day=2024-01-09"}
    as_of = F.lit(rd.agg(F.max("ts")).first()[0])
    plan = table.window(as_of, 10)._jdf.queryExecution().executedPlan().toString()
    read = [line for line in plan.splitlines() if "facts" in line and "PartitionFilters" in line]
    assert read and all("(day#" in line and " = " in line.split("PartitionFilters")[1] for line in read)
    assert table.window(as_of, 10).first()["n_readings"] == kpi.recent(rd, as_of, 10).count()


def test_sketches(spark, tmp_path):
    draw = random.Random(4)
    rows = [(f"d{i % 4}", "a" if i % 3 else "b", draw.choice([draw.random(), 0.5, draw.gauss(0, 9)]) if i % 50 else None) for i in range(60_000)]
    df = spark.createDataFrame(rows, "day string, name string, v double")
    path = str(tmp_path / "s")
    rollups.sketched(df, "v", path, ["day", "name"])
    before = rollups.sketch_quantiles(spark.read.parquet(path), [0.5], ["name"]).collect()
    rollups.sketched(df.where("day = 'd1'"), "v", path, ["day", "name"])  # one day made anew
    stored = spark.read.parquet(path)
    assert stored.count() == 8 and sorted(before) == sorted(rollups.sketch_quantiles(stored, [0.5], ["name"]).collect())
    worst = 0.0
    for r in rollups.sketch_quantiles(stored, [0.01, 0.5, 0.95, 0.99], ["name"]).collect():
        values = sorted(v for _, n, v in rows if n == r["name"] and v is not None)
        assert r["n"] == len(values)
        low, high = sum(v < r["value"] for v in values) / len(values), sum(v <= r["value"] for v in values) / len(values)
        worst = max(worst, low - r["p"], r["p"] - high)
    assert worst < 0.003
    few = df.where("v IS NOT NULL").limit(900)
    rollups.sketched(few, "v", str(tmp_path / "few"), ["day", "name"])
    exact = sorted(r["v"] for r in few.collect())
    assert rollups.sketch_quantiles(spark.read.parquet(str(tmp_path / "few")), [0.5]).first()["value"] == exact[len(exact) // 2 - 1]
    rollups.sketched(df.limit(0), "v", str(tmp_path / "none"), ["day", "name"])
