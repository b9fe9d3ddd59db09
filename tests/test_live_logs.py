"""Rolling features of a stream, the state log and corrected alerts against their batch twins."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.learning import boosting, scale, serving
from sunloom.operators import features
from sunloom.sources import bindings
from sunloom.streaming import alerts, corrections, live, rolling, state
from sunloom.streaming.log import ChangeLog, _numbers
from test_streaming import drain, feed

KEYS, FRAMES, LAGS = ["plant_id", "inverter_id"], {"1h": 3, "24h": 8}, {"1d": 7, "7d": 20}


def readings_of(spark, n=400, seed=1):
    """Devices of very different lengths; some values are missing, times repeat."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        device = draw.choice([1, 1, 1, 2, 2, 3]) if i > 5 else 4
        second = i * 7 + draw.choice([0, 0, 3])
        rows.append((i, second, f"Plant {device % 2}", device, draw.gauss(300, 90), draw.gauss(30, 4) if i % 9 else None, float(i % 5), float(i % 3),
                     float(i) if i % 4 else None, draw.choice([0, 0, 8, 464]), 5120))
    df = spark.createDataFrame(rows, "reading_id bigint, s bigint, plant_id string, inverter_id bigint, power double, temp double, pv1_current double, "
                                     "pv2_current double, kwh_total double, alarm_code int, op_state int")
    return df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_704_067_200)).drop("s")


@pytest.mark.parametrize("block,shuffle", [(5, 0), (3, 15), (72, 40)])
def test_features_of_a_stream(spark, tmp_path, block, shuffle):
    """Out of order within the bound; every reading before the last watermark has the features of a batch."""
    rows = readings_of(spark)
    draw = random.Random(3)
    late = {r["reading_id"]: r["reading_id"] + draw.uniform(0, shuffle) for r in rows.select("reading_id").collect()}
    arrival = spark.createDataFrame(list(late.items()), "reading_id bigint, arrival double")
    (tmp_path / "in").mkdir()
    stream = feed(spark, rows.join(arrival, "reading_id"), str(tmp_path / "in"), parts=7, by="arrival").drop("arrival")
    made = rolling.rolling_features(stream, KEYS, "ts", "reading_id", "10 minutes", FRAMES, LAGS, block=block)
    got = drain(made, f"rolled{block}", tmp_path)
    end = rows.agg(F.max("ts")).first()[0].timestamp() - 600
    want = features.add_features(rows, KEYS, "ts", "reading_id", FRAMES, LAGS).where(F.unix_timestamp("ts") < end)
    names = [c for c in want.columns if c != "ts"]
    assert set(got.columns) == set(want.columns)
    left = {r["reading_id"]: r for r in got.select(names).collect()}
    right = {r["reading_id"]: r for r in want.select(names).collect()}
    assert left.keys() == right.keys() and len(left) > 200
    for i, r in right.items():
        for c in names:
            a, b = left[i][c], r[c]
            assert a == b or isinstance(a, float) and b is not None and a == pytest.approx(b, abs=1e-9), (i, c, a, b)


def test_silent_devices_are_forgotten(spark, tmp_path):
    day = 86_400
    rows = [(i, d, t) for i, (d, t) in enumerate([(1, 0), (1, 60), (2, 3 * day), (2, 5 * day), (1, 6 * day), (2, 6 * day), (2, 7 * day), (2, 8 * day)])]
    df = spark.createDataFrame(rows, "reading_id bigint, inverter_id bigint, s bigint").select(
        "reading_id", "inverter_id", F.timestamp_seconds(F.col("s") + 1_704_067_200).alias("ts"), F.lit(5.0).alias("power"))
    (tmp_path / "in").mkdir()
    stream = feed(spark, df, str(tmp_path / "in"), parts=8)
    got = drain(rolling.rolling_features(stream, ["inverter_id"], "ts", "reading_id", "1 second", {"24h": 2}, {"1d": 1}, forget_days=2), "forgot", tmp_path)
    lags = {r["reading_id"]: r["power_lag_1d"] for r in got.collect()}
    assert lags == {0: 0.0, 1: 5.0, 2: 0.0, 3: 5.0, 4: 0.0, 5: 5.0, 6: 5.0}


def test_stream_scored_with_the_stored_model(spark, tmp_path):
    """Features of the stream, scored in `full` mode by a model that was trained and stored, as the batch does it."""
    rows = readings_of(spark, 300, 5).fillna(0)
    batch = features.add_features(rows, KEYS, "ts", "reading_id", FRAMES, LAGS)
    columns = ["power", "power_rmean_24h", "power_lag_1d", "alarm_streak", "hour_sin"]
    scaler = scale.fit_scaler(batch, columns)
    labelled = scale.scaled(batch.withColumn("y", (F.col("power") > 330).cast("int") + (F.col("alarm_code") == 464).cast("int")), scaler, columns)
    model = boosting.fit(labelled, "y", columns, {"n_estimators": 5, "max_depth": 3}, key="reading_id")
    serving.save_model(serving.RiskModel(model, scaler, columns, model.params), str(tmp_path / "model"))
    bundle = serving.load_model(spark, str(tmp_path / "model"))
    (tmp_path / "in").mkdir()
    stream = feed(spark, rows, str(tmp_path / "in"), parts=5)
    made = rolling.rolling_features(stream, KEYS, "ts", "reading_id", "1 second", FRAMES, LAGS)
    got = drain(serving.score_readings(made, bundle, "full"), "full", tmp_path).select("reading_id", "probabilities", "category").collect()
    want = {r["reading_id"]: r for r in serving.score_readings(batch, bundle, "full").collect()}
    assert len(got) > 290 and {r["category"] for r in got} != {"A"}
    assert all(r["probabilities"] == want[r["reading_id"]]["probabilities"] and r["category"] == want[r["reading_id"]]["category"] for r in got)


# ---------------------------------------------------------------------------------------------------------- state log
def scored(spark, devices, batch):
    return spark.createDataFrame([(d, batch * 1000 + d, batch, "B", 5120) for d in devices],
                                 "inverter_id bigint, reading_id bigint, s bigint, category string, op_state int").withColumn(
        "ts", F.timestamp_seconds("s")).drop("s")


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def count(path):
    return sum(f.endswith(".parquet") for _, _, files in os.walk(path) for f in files)


def test_state_log(spark, tmp_path):
    """A small batch writes little, many batches leave few files, a batch that runs again changes nothing."""
    folder = str(tmp_path / "state")
    state.merge_batch(scored(spark, range(5000), 0), 0, folder, every=10)
    whole = size(folder)
    state.merge_batch(scored(spark, range(0, 5000, 100), 1), 1, folder, every=10)
    assert size(folder) - whole < whole / 10  # one device in a hundred; the rest is what any file has
    newest = {d: 0 for d in range(5000)} | {d: 1 for d in range(0, 5000, 100)}
    most = 0
    for batch in range(2, 45):
        devices = [(batch * 37 + k) % 5000 for k in range(20)]
        state.merge_batch(scored(spark, devices, batch), batch, folder, every=10)
        newest |= {d: batch for d in devices}
        most = max(most, count(folder))
    log = state.device_log(spark, folder, every=10)

    def held(before=None):
        return {r["inverter_id"]: (r["reading_id"] - r["inverter_id"]) // 1000 for r in log.read(before).collect()}

    assert held() == newest
    assert most < 100 and len(_numbers(spark, f"{folder}/base", "version")) == 2
    # the batch that ends with a new base, and the one after it, run again
    before = held(40)
    for batch in (39, 40):
        devices = [(batch * 37 + k) % 5000 for k in range(20)]
        found = held(batch)
        state.merge_batch(scored(spark, devices, batch), batch, folder, every=10)
        assert held(batch) == found
    assert held(40) == before and held() == newest
    # a base without the marker of its job does not count
    os.remove(f"{folder}/base/version=39/_SUCCESS")
    assert held() == newest


def test_log_without_rows(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "none"), lambda rows: rows)
    assert log.read() is None
    log.write(spark.range(0), 0)
    assert log.read().count() == 0 and log.read(before=0) is None


# -------------------------------------------------------------------------------------------------------- corrections
def graded(spark, n=300):
    draw = random.Random(9)
    rows = [(draw.choice([1, 1, 1, 2, 3]), i, i // 2 * 60, draw.choice("AABCDE"), draw.choice(["Fault x", None])) for i in range(n)]
    df = spark.createDataFrame(rows, "inverter_id bigint, reading_id bigint, s bigint, category string, fault_type string")
    return df.withColumn("ts", F.timestamp_seconds("s")).drop("s").cache()


@pytest.mark.parametrize("seed", [1, 2])
def test_folded_corrections_equal_history(spark, tmp_path, seed):
    df = graded(spark)
    ids = list(range(300))
    random.Random(seed).shuffle(ids)
    folder = str(tmp_path / "live")
    for number in range(6):
        part = ids[number * 50:(number + 1) * 50] + (ids[:5] if number == 3 else [])  # five readings come twice
        corrections.correct_batch(df.where(F.col("reading_id").isin(part)), number, folder, "10 days", every=2)
        if number == 4:  # runs again after a failure
            corrections.correct_batch(df.where(F.col("reading_id").isin(part)), number, folder, "10 days", every=2)
    log = spark.read.parquet(os.path.join(folder, "alerts"))
    assert log.where("sign < 0").count() > 0
    assert sorted(map(str, corrections.folded(log).collect())) == sorted(map(str, alerts.alerts(df).select(corrections.ALERT).collect()))


def test_corrections_within_the_bound(spark, tmp_path):
    """A reading later than the bound is left out; history shrinks to the bound and one reading before it."""
    df = graded(spark)
    folder = str(tmp_path / "live")
    for number in range(6):
        corrections.correct_batch(df.where(f"reading_id >= {number * 50} AND reading_id < {number * 50 + 50} AND reading_id <> 10"), number, folder,
                                  "20 minutes", every=2)
    corrections.correct_batch(df.where("reading_id = 10"), 6, folder, "20 minutes", every=2)
    log = corrections.folded(spark.read.parquet(os.path.join(folder, "alerts")))
    assert sorted(map(str, log.collect())) == sorted(map(str, alerts.alerts(df.where("reading_id <> 10")).select(corrections.ALERT).collect()))
    assert corrections.recent_log(spark, os.path.join(folder, "recent"), "20 minutes").read().count() < 60


def test_live_loop_with_corrections(spark, small, tmp_path):
    readings = bindings.readings(spark, small).withColumn("arrival", F.xxhash64("reading_id"))
    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")
    stream = feed(spark, readings, str(tmp_path / "in"), parts=5, by="arrival").drop("arrival")
    live.run_live(stream, out, str(tmp_path / "cp"), {"availableNow": True}, late="60 days", every=2).awaitTermination(300)
    log = spark.read.parquet(os.path.join(out, "alerts"))
    assert log.select("batch").distinct().count() == 5
    assert sorted(map(str, corrections.folded(log).collect())) == sorted(
        map(str, alerts.alerts(readings).select(corrections.ALERT).collect()))
    newest = readings.groupBy("inverter_id").agg(F.max_by("reading_id", F.struct("ts", "reading_id")).alias("reading_id"))
    assert sorted(state.read_state(spark, os.path.join(out, "state")).select("inverter_id", "reading_id").collect()) == sorted(newest.collect())


def test_frame_stats():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2))
    x[rng.random((60, 2)) < 0.3] = np.nan
    x[:8] = np.nan
    rolled = rolling.frame_stats(x, 6, 8, True)
    for k in range(8, 60):
        for j in range(2):
            seen = x[k - 5:k + 1, j]
            seen = seen[~np.isnan(seen)]
            want = [np.mean(seen), np.std(seen, ddof=1) if len(seen) > 1 else 0.0, seen.min(), seen.max()] if len(seen) else [np.nan, 0.0, np.nan, np.nan]
            assert np.allclose([s[k - 8, j] for s in rolled], want, equal_nan=True)


@pytest.mark.parametrize("rows", [1, 2, 7, 12, 288])
def test_long_frame_stats(rows, monkeypatch):
    """Running values of blocks against every frame by itself: missing, constant, far and infinite values, several parts."""
    monkeypatch.setattr(rolling, "BLOCKS", 5)
    monkeypatch.setattr(rolling, "FEW_ROWS", 0)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(rows * 23 + 5, 4)) + [0, 1e6, 5, 0]
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:rows + 3] = np.nan
    x[:, 2] = np.where(np.arange(len(x)) < len(x) // 2, 500.25, x[:, 2])
    calls = []
    monkeypatch.setattr(rolling, "_laid_out", lambda *a, f=rolling._laid_out: calls.append(len(a[0])) or f(*a))
    got = rolling.frame_stats(x, rows, rows - 1, True)
    assert sum(calls) < 2 * rows + 1  # the work follows the rows; only a short end is laid out
    for a, b in zip(got, rolling._laid_out(x, rows, True)):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True)
    constant = got[1][rows * 2 + 3:len(x) // 2 - rows, 2]
    assert len(constant) and not constant.any()
    x[rows * 9, 0] = np.inf
    for a, b in zip(rolling.frame_stats(x, rows, rows - 1, True), rolling._laid_out(x, rows, True)):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True)
