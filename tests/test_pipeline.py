"""Ingest of generated plant files, cleaning, and the staged pipeline."""

import math
import os

import pytest
from pyspark.sql import functions as F

from sunloom import pipeline
from sunloom.operators import clean
from sunloom.sources import ingest, stages

START = 1_706_745_600_000  # 2024-02-01


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    """Two plants with different columns, a bad cell, a copied row, a time before 2024 and a missing time."""
    root = tmp_path_factory.mktemp("raw")
    head1 = ("timestamp,mac,_id,inverters[0].power,inverters[0].temp,inverters[0].alarm_code,inverters[0].op_state,"
             "inverters[0].kwh_total,inverters[1].power,inverters[1].temp,inverters[1].alarm_code,inverters[1].op_state,"
             "inverters[1].pv1_current,inverters[1].pv2_current,meters[0].pf,meters[0].v_r,smu[0].string1,smu[1].string1,note")
    lines = [head1]
    for i in range(160):
        alarm = 464 if i % 40 in (30, 31) else (8 if i % 40 == 5 else 0)
        kwh = "" if i % 4 == 1 else str(100 + i)
        power = 500 + 100 * math.sin(i / 5)
        lines.append(f"{START + i * 300_000},AA,x{i},{power:.3f},{30 + i % 7},{alarm},5120,{kwh},{power / 2:.3f},{25 + i % 5},0,"
                     f"{7 if i % 50 == 20 else 5120},{i % 9},{i % 4},0.9{i % 10},23{i % 10},{i},{i + 1},n{i}")
    lines.append(lines[3])
    lines.append(lines[4].replace(str(START + 3 * 300_000), str(START - 10 ** 11)))
    lines.append("," + lines[5].split(",", 1)[1])
    cells = lines[8].split(",")
    cells[0], cells[4] = str(START + 500 * 300_000), "broken"
    lines.append(",".join(cells))
    (root / "Plant 1").mkdir()
    (root / "Plant 1" / "a.csv").write_text("\n".join(lines) + "\n")
    head2 = "timestamp,mac,inverters[0].power,inverters[0].limit_percent,sensors[0].ambient_temp"
    rows = [head2] + [f"{START + i * 300_000},BB,{300 + i % 50},{'' if i % 3 else 90},{20 + i % 4}" for i in range(80)]
    (root / "Plant 2").mkdir()
    (root / "Plant 2" / "b.csv").write_text("\n".join(rows) + "\n")
    (root / "Plant 2" / "c.csv").write_text("\n".join([head2, f"{START + 90 * 300_000},BB,999,50,21"]) + "\n")
    return str(root)


def test_names():
    names = ["mac", "inverters[0].power", "inverters[12].pv1_current", "meters[0].pf", "smu[0].string1", "smu[1].string1"]
    assert ingest.device_columns(names) == {0: {"power": names[1]}, 12: {"pv1_current": names[2]}}
    assert ingest.shared_names(names) == {"mac": "mac", "pf": "meters[0].pf", "string1": "smu[0].string1"}


def test_ingest(spark, source):
    long = ingest.ingest(spark, source).cache()
    counts = {tuple(r)[:2]: r["count"] for r in long.groupBy("plant_id", "inverter_id").count().collect()}
    assert counts == {("Plant 1", 1): 164, ("Plant 1", 2): 164, ("Plant 2", 1): 81}
    types = dict(long.dtypes)
    assert types["timestamp"] == "double" and types["power"] == "double" and types["temp"] == "double"
    assert types["note"] == "string" and types["mac"] == "string"
    one = long.where(f"plant_id = 'Plant 1' and timestamp = {START}").orderBy("inverter_id").collect()
    assert one[0]["pv1_current"] is None and one[1]["kwh_total"] is None and one[0]["string1"] == 0
    assert one[0]["pf"] == one[1]["pf"]
    assert long.where("power is not null and temp is null and plant_id = 'Plant 1'").count() == 1  # the bad cell


def test_clean(spark, source):
    done = clean.clean(ingest.ingest(spark, source)).cache()
    assert done.where("plant_id = 'Plant 1' and inverter_id = 1").count() == 161
    assert "_id" not in done.columns
    assert done.agg(F.min("timestamp").cast("string")).first()[0].startswith("2024-02-01 00:00:00")
    numeric = clean.numeric_columns(done)
    assert done.select([F.count_if(F.col(c).isNull()).alias(c) for c in numeric]).first() == tuple([0] * len(numeric))
    kwh = [r[0] for r in done.where("plant_id = 'Plant 1' and inverter_id = 1").orderBy("timestamp").limit(4).select("kwh_total").collect()]
    assert kwh[1] == kwh[0] == 100.0 and kwh[2] == 102.0  # filled forward
    assert clean.feature_columns(done.select("power", "temp", "mac", "inverter_id", "timestamp")) == ["power", "temp"]


def test_sample(spark, source):
    assert 0 < ingest.ingest(spark, source, share=0.3).count() < 409


@pytest.fixture(scope="module")
def staged(spark, source, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stages"))
    options = {"frames": {"1h": 12, "24h": 48}, "periods": {"1d": 48}, "lookahead": 10, "trees": 20}
    for name in pipeline.STAGES[:-1]:
        pipeline.run_stage(spark, name, source, folder, **options)
    return folder


def test_stages(spark, staged):
    table = stages.load_stage(spark, staged, "anomaly")
    assert {"power_rmean_24h", "power_lag_1d", "alarm_streak", "hour_sin", "risk_label", "iso_forest_score",
            "zscore_anomaly", "kwh_daily_delta"} <= set(table.columns)
    assert {r[0] for r in table.select("risk_label").distinct().collect()} >= {0, 2}
    # a restart of a later stage reads the stored one
    again = pipeline.run_stage(spark, "labels", "unused", staged, lookahead=10)
    assert again.count() == table.count()


def test_train_stage(spark, staged):
    params = {"max_depth": 2, "learning_rate": 0.3, "n_estimators": 2, "subsample": 1.0, "colsample_bytree": 1.0,
              "min_child_weight": 1, "gamma": 0.0}
    slim = stages.load_stage(spark, staged, "anomaly").select(
        "row_id", "timestamp", "risk_label", "power", "temp", "alarm_active", "power_rmean_24h")
    report = pipeline.train(spark, slim, staged, params, folds=2)
    rows = {(r["split"], r["part"]): r for r in report.collect()}
    assert ("full", "held") in rows and ("fold1", "train") in rows
    assert all(0 <= r["f1"] <= 1 for r in rows.values())
    top = spark.read.option("header", True).csv(os.path.join(staged, "top_features"))
    assert top.columns == ["feature", "importance"] and 0 < top.count() <= 5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01", 2.0), (2, "2024-01-02", 3.0)], "id int, day string, v double")
    path = str(tmp_path / "fact")
    stages.append_rows(df, path, ["day"])
    stages.append_rows(df, path, ["day"])
    assert spark.read.parquet(path).count() == 4
    bad = tmp_path / "inv.csv"
    bad.write_text("id,capacity\n1,5.5\nx,7\n3,oops\n4,2\n")
    good, quarantined = stages.read_quarantined(spark, str(bad), "id int, capacity double")
    assert [r["id"] for r in good.collect()] == [1, 4]
    assert [r["_bad"] for r in quarantined.collect()] == ["x,7", "3,oops"]


def test_results_round_trip(spark, tmp_path):
    score = ", ".join(f"named_struct('score', {v}D) AS {n}" for n, v in (
        ("json_validity", 1.0), ("hallucination", 0.8), ("urgency_accuracy", 1.0), ("completeness", 0.5), ("response_quality", 1.0)))
    df = spark.range(5).selectExpr(
        "concat('m', id % 2) AS model", "concat('Model ', id % 2) AS display_name", "'p' AS provider", "'x' AS model_id",
        "'chat' AS task", "'s' AS scenario_name", "'no_risk' AS risk_class", "concat('text \"', id) AS response",
        "id / 2 AS latency_seconds", "cast(id AS int) AS input_tokens", "cast(null AS int) AS output_tokens",
        "cast(null AS string) AS error", "id AS n").selectExpr("*", f"struct(0.9D AS overall_score, {score}) AS evaluation")
    path = str(tmp_path / "study")
    stages.write_results(df, path)
    back = stages.read_results(spark, path)
    assert back.count() == 5 and back.select("evaluation.completeness.score").distinct().first()[0] == 0.5
    assert sorted(r[0] for r in back.select("response").collect()) == [f'text "{i}' for i in range(5)]
