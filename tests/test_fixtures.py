"""Hand-computed values of single operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sunloom import config
from sunloom.functions import grading, numeric, texts, timeparts
from sunloom.operators import clean, features, fleet, kpi, labels, quantiles, series
from sunloom.responses import evaluate, prompts
from sunloom.retrieval import chunks, search


def column(spark, values, kind="double"):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], f"k int, i int, v {kind}")
    return df.withColumn("ts", F.timestamp_seconds(F.col("i") * 300))


def values(df, name):
    return [r[0] for r in df.orderBy("i").select(name).collect()]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_rolling(spark):
    df = features.rolling(column(spark, [1.0, 2.0, 4.0, 8.0]), ["k"], ["ts", "i"], ["v"], {"x": 3}, None)
    assert values(df, F.round("v_rmean_x", 4)) == [1.0, 1.5, 2.3333, 4.6667]
    assert values(df, F.round("v_rstd_x", 4)) == [0.0, 0.7071, 1.5275, 3.0551]


def test_fill_delta_streak_lookahead(spark):
    assert values(series.fill_forward(column(spark, [None, 5.0, None, None, 7.0, None]), ["k"], "ts", "i", ["v"]), "v") == \
        [None, 5, 5, 5, 7, 7]
    steps = column(spark, [10.0, 12.0, 11.0, 15.0]).withColumn("d", features.counter_step(["k"], ["ts", "i"], "v"))
    assert values(steps, "d") == [0, 2, 0, 4]
    codes = column(spark, [0, 8, 8, 0, 8], "int").withColumn("alarm_active", (F.col("v") != 0).cast("int"))
    assert values(features.alarm_streak(codes, ["k"], "ts", "i"), "alarm_streak") == [0, 1, 2, 0, 1]
    seen = column(spark, [0, 0, 0, 1, 0], "int")
    here, ahead = labels.seen_ahead(["k"], ["ts", "i"], "v", 3)
    assert values(seen.withColumn("__back", here).withColumn("a", ahead), "a") == [0, 1, 1, 1, 0]


def test_rounding(spark):
    row = one(spark, numeric.js_round(F.lit(2.5)), numeric.even_round(F.lit(2.5)), numeric.js_round(F.lit(-2.5)),
              numeric.strict_greatest(F.lit(1), F.lit(None).cast("int")), F.greatest(F.lit(1), F.lit(None).cast("int")))
    assert tuple(row) == (3.0, 2.0, -2.0, None, 1)


def test_quartile_bounds(spark):
    df = column(spark, [0.0, 1.0, 2.0, 3.0, 4.0])
    row = quantiles.iqr_bounds(df, ["v"], 3.0).first()
    assert (row["q1"], row["q3"], row["low"], row["high"]) == (1, 3, -5, 9)
    flat = quantiles.iqr_bounds(column(spark, [2.0, 2.0, 2.0]), ["v"], 3.0).first()
    assert flat["low"] is None
    kept = clean.winsorise(column(spark, [0.0, 1.0, 2.0, 3.0, 100.0, None]), ["v"])
    assert values(kept, "v")[-1] is None and values(kept, "v")[4] == 9.0


@pytest.mark.parametrize("index,chance,expected", [(2, 0.4, "E"), (1, 0.70, "D"), (1, 0.69, "C"), (0, 0.90, "A"), (0, 0.70, "B"), (0, 0.69, "C")])
def test_grades(spark, index, chance, expected):
    p = [0.0, 0.0, 0.0]
    p[index] = chance
    assert one(spark, grading.grade(F.lit(index), F.array(*[F.lit(x) for x in p])))[0] == expected


def test_first_maximum_wins(spark):
    assert one(spark, grading.best_class(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2))))[0] == 0


@pytest.mark.parametrize("category,reading,expected", [
    ("E", {"module_temp": 71.0}, "Overheating — Thermal Shutdown Risk"),
    ("E", {"module_temp": 40.0, "irradiation": 299.0}, "Grid Fault — Frequency Deviation"),
    ("E", {"module_temp": 40.0, "irradiation": 800.0, "dc_voltage": 0.0, "dc_current": 0.0}, "Inverter Shutdown — Critical"),
    ("E", {}, "Ground Fault — Insulation Failure"), ("D", {"dc_current": 4.0, "alarm_code": 7}, "String Degradation"),
    ("D", {"alarm_code": 3021}, "Alarm Code 3021 — Operational Fault"), ("D", {}, "String Degradation"),
    ("C", {"ac_power": 4.0}, "Low Power Output — String Issue"), ("C", {"dc_voltage": 31.0}, "Partial Shading — Performance Loss"),
    ("C", {"alarm_code": 2010}, "Communication Issue — Alarm Code 2010"), ("A", {}, None), ("B", {}, None)])
def test_fault_wording(spark, category, reading, expected):
    assert one(spark, grading.fault_text(F.lit(category), {k: F.lit(v) for k, v in reading.items()}))[0] == expected


def test_op_state_zero_is_off_and_missing_is_running(spark):
    row = one(spark, grading.is_online(F.lit("A"), F.lit(0)), grading.is_online(F.lit("A"), F.lit(None).cast("int")),
              grading.is_online(F.lit("offline"), F.lit(5120)))
    assert tuple(row) == (False, True, False)


def test_zero_std_counts_as_one(spark):
    from sunloom.operators import anomaly
    df = features.rolling(column(spark, [5.0] * 4).withColumnRenamed("v", "power"), ["k"], ["ts", "i"], ["power"], {"24h": 3}, None)
    assert values(anomaly.add_zscores(df), "power_zscore") == [0, 0, 0, 0]


def test_revenue_lost(spark):
    as_of = dt.datetime(2024, 3, 10)
    rows = [(1, as_of - dt.timedelta(hours=10), "D"), (1, as_of - dt.timedelta(hours=2), "E"), (2, as_of - dt.timedelta(hours=200), "D")]
    readings = spark.createDataFrame(rows, "inverter_id int, ts timestamp, category string")
    fleet_rows = spark.createDataFrame([(1, 100.0, "D"), (2, 100.0, "E")], "inverter_id int, capacity_kw double, current_category string")
    got = kpi.revenue_lost(readings, fleet_rows, F.lit(as_of)).collect()
    assert [(r["inverter_id"], r["loss_inr"]) for r in got] == [(1, 4000.0)]


def test_kpis_of_no_readings(spark):
    readings = spark.createDataFrame([], "inverter_id int, ts timestamp, is_faulty boolean, ac_power double, dc_voltage double, "
                                         "dc_current double, module_temp double, irradiation double")
    fleet_rows = spark.createDataFrame([], "inverter_id int, capacity_kw double, current_category string, is_online boolean")
    row = kpi.fleet_kpis(readings, fleet_rows, F.lit(dt.datetime(2024, 1, 1))).first()
    assert (row["vcoy"], row["ppr"], row["eis"], row["n_readings"]) == (0, 0, 0, 0)
    assert kpi.healthy_share(fleet_rows).first()["healthy_pct"] == 100
    assert kpi.installed_capacity(fleet_rows).first()[0] == 1


SEED_FLEET = [  # name, plant, block, category, online
    ("INV-P1-L1-0", 1, "A", "A", True), ("INV-P1-L1-1", 1, "A", "D", True), ("INV-P1-L2-0", 1, "B", "E", True),
    ("INV-P1-L2-1", 1, "B", "A", True), ("INV-P2-L1-0", 2, "A", "D", True), ("INV-P2-L1-1", 2, "A", "B", True),
    ("INV-P2-L2-0", 2, "B", "C", True), ("INV-P2-L2-1", 2, "B", "E", False), ("INV-P3-L1-0", 3, "A", "A", True),
    ("INV-P3-L1-1", 3, "A", "A", True), ("INV-P3-L2-0", 3, "B", "C", True), ("INV-P3-L2-1", 3, "B", "C", True)]


def test_seed_fleet(spark):
    df = spark.createDataFrame(SEED_FLEET, "inverter_id string, plant_id int, block string, current_category string, is_online boolean")
    assert tuple(fleet.category_columns(df).first()) == (4, 1, 3, 2, 2, 0)
    two = fleet.status_counts(df.where("plant_id in (1, 2)")).first()
    assert tuple(two) == (8, 3, 1, 4, 1)
    assert tuple(fleet.status_counts(df.where("plant_id in (2, 3)")).first()) == (8, 3, 3, 2, 1)
    assert [r[0] for r in fleet.needs_attention(df, 2).select("current_category").collect()] == ["E", "E"]


def test_windows_of_words(spark):
    df = spark.createDataFrame([(1, "a b  c d\n e"), (2, "  "), (3, "one two")], "doc_id int, text string")
    rows = chunks.chunk_table(df, size=3, overlap=1, min_chars=-1).orderBy("doc_id", "chunk_id").collect()
    assert [(r[0], r[2]) for r in rows] == [(1, "a b c"), (1, "c d e"), (1, "e"), (3, "one two")]
    assert chunks.chunk_table(df, size=3, overlap=1).count() == 0


@pytest.mark.parametrize("block_bytes", [16, 1 << 20])
def test_search_equals_brute_force(spark, block_bytes):
    import numpy as np
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(300, 6)), rng.normal(size=(5, 6))
    x[7] = x[9] = x[8]
    items = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id int, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)], "query_id int, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in search.top_k(items, asked, 4, block_bytes=block_bytes).collect()}
    sims = (x @ q.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1) + 1e-9)
    for j in range(5):
        order = sorted(range(300), key=lambda i: (-round(sims[i, j], 12), i))[:4]
        assert [got[j, r] for r in range(1, 5)] == order
    assert search.top_k(items.limit(2), asked, 4).count() == 10
    assert abs(one(spark, search.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))))[0] - 0.5 ** 0.5) < 1e-6


GOOD = '{"summary": "s 5", "key_factors": [{"feature": "power"}], "recommended_actions": ["x"], "urgency": "Routine "}'
REPLIES = [  # reply, task, risk, json, urgency
    (GOOD, "explanation", "no_risk", 1.0, 1.0), (GOOD, "explanation", "shutdown_risk", 1.0, 0.3),
    ("```json\n" + GOOD + "\n```", "explanation", "no_risk", 1.0, 1.0), (GOOD + " tail", "explanation", "no_risk", 0.0, 0.0),
    (GOOD + "," + GOOD, "explanation", "no_risk", 0.0, 0.0), ("{\"a\": [1}", "ticket", "no_risk", 0.0, 1.0),
    ("plain words", "chat", "no_risk", 0.0, 1.0), ("{}", "chat", "no_risk", 1.0, 1.0), ("{\"title\": 1}", "ticket", "no_risk", 0.6, 1.0),
    ("", "explanation", "no_risk", 0.0, 0.0), (None, "ticket", "no_risk", 0.0, 1.0)]


def test_reply_scores(spark):
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(REPLIES)], "i int, response string, task string, risk_class string")
    df = df.withColumn("known", F.array(F.lit("power"))).withColumn(
        "raw", F.array(F.struct(F.lit("inverters[0].temp").alias("feature"), F.lit(40.0).alias("value"))))
    rows = evaluate.evaluate(df).orderBy("i").collect()
    assert [r["json_validity"] for r in rows] == [r[3] for r in REPLIES]
    assert [r["urgency_accuracy"] for r in rows] == [r[4] for r in REPLIES]
    assert rows[0]["completeness"] == round(6 / 7, 3) and rows[-1]["completeness"] == 0 and rows[-1]["response_quality"] == 0


def test_hallucination(spark):
    raw = F.array(F.struct(F.lit("inverters[0].temp").alias("feature"), F.lit(40.0).alias("value")))
    known = F.array(F.lit("inverters[0].temp"))
    text = "inverters[9].temp and inverters[9].temp at 45.0 °C, inverters[0].temp at 40.4°C"
    assert abs(one(spark, evaluate.hallucination(F.lit(text), known, raw))[0] - 0.6) < 1e-9
    assert one(spark, evaluate.hallucination(F.lit(""), known, raw))[0] == 0


def test_prompt_and_sentence(spark):
    entries = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(v).alias("value")) for n, v in (
        ("inverters[0].temp", 0.35), ("meters[0].freq", -0.5), ("x.other", 0.1))])
    row = one(spark, texts.signed_lines(texts.top_by_size(entries, 2), entries), prompts.retrieval_query(entries, F.lit("no_risk")),
              texts.factor_sentence(F.get(texts.top_by_size(entries, 1), F.lit(0))))
    assert row[0] == "  • meters[0].freq: -0.5000  (raw value: -0.5)\n  • inverters[0].temp: +0.3500  (raw value: 0.35)"
    assert row[1] == "inverter no_risk grid frequency deviation anti-islanding temperature overheating thermal protection"
    assert row[2] == "meters[0].freq (50% impact) — value is below expected range"


def test_ages(spark):
    as_of = F.lit("2024-01-01 12:00:00").cast("timestamp")
    ages = [one(spark, timeparts.age_text(F.lit(t).cast("timestamp"), as_of))[0] for t in (
        None, "2024-01-01 11:59:30", "2024-01-01 11:01:00", "2024-01-01 08:55:00")]
    assert ages == ["Unknown", "Just now", "59 min ago", "3h 5m ago"]


def test_thresholds(spark):
    one_row = spark.range(1)
    bands = fleet.threshold_bands(F.lit(config.THRESHOLDS_JSON), one_row).orderBy("band").collect()
    assert [tuple(r) for r in bands][0] == ("A", 90, 100) and len(bands) == 5
    got = spark.createDataFrame([(95,), (74,), (0,), (101,)], "s int")
    assert [r["band"] for r in fleet.banded(got, F.col("s")).collect()] == ["A", "C", "E", None]
