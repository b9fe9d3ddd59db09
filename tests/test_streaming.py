"""Streaming jobs over file sources; each must agree with its batch twin."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sunloom.functions.grading import alert_type
from sunloom.learning import serving
from sunloom.sources import bindings
from sunloom.streaming import alerts, live, stale, state


@pytest.fixture(scope="module")
def readings(spark, small):
    return bindings.readings(spark, small).cache()


def feed(spark, df, folder, parts=4, by="ts"):
    """Write `df` as `parts` files in order of `by` and open them as a stream, one file per micro-batch."""
    order = df.orderBy(by, "reading_id").toPandas()
    size = -(-len(order) // parts)
    for i in range(parts):
        path = os.path.join(folder, f"part{i}.parquet")
        order.iloc[i * size:(i + 1) * size].to_parquet(path, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(stream, name, tmp_path, mode="append"):
    query = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start())
    query.awaitTermination(300)
    return stream.sparkSession.table(name)


def test_alerts_equal_batch(spark, readings, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    live.run_live(feed(spark, readings, str(folder)), out, str(tmp_path / "cp"), {"availableNow": True}).awaitTermination(300)
    got = spark.read.parquet(os.path.join(out, "alerts"))
    assert got.select("batch").distinct().count() == 4
    before = F.lag("category", 1, "A").over(Window.partitionBy("inverter_id").orderBy("ts", "reading_id"))
    batch = (readings.withColumn("category_from", before).withColumn("type", alert_type(F.col("category_from"), F.col("category")))
             .where("type is not null"))
    columns = ["inverter_id", "reading_id", "category_from", "type"]
    assert sorted(got.select(columns).collect()) == sorted(batch.select(columns).collect())
    assert sorted(alerts.alerts(readings).select(columns).collect()) == sorted(batch.select(columns).collect())
    assert got.count() > 0


def test_alert_rule(spark):
    pairs = [("A", "D"), ("D", "D"), ("D", "E"), ("E", "C"), ("A", "C"), ("C", "C")]
    df = spark.createDataFrame(pairs, "f string, t string").withColumn("i", F.monotonically_increasing_id())
    got = [r[0] for r in df.orderBy("i").select(alert_type(F.col("f"), F.col("t"))).collect()]
    assert got == ["warning", None, "critical", None, "info", None]


def test_live_state_equals_latest(spark, readings, tmp_path):
    """Out-of-order arrival: files are fed newest first, the state still holds the newest by event time."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    stream = feed(spark, readings.withColumn("back", -F.unix_micros("ts")), str(folder), by="back")
    live.run_live(stream, out, str(tmp_path / "cp"), {"availableNow": True}).awaitTermination(300)
    got = state.read_state(spark, os.path.join(out, "state"))
    newest = readings.groupBy("inverter_id").agg(F.max_by("reading_id", F.struct("ts", "reading_id")).alias("reading_id"))
    assert sorted(got.select("inverter_id", "reading_id").collect()) == sorted(newest.collect())
    assert spark.read.parquet(os.path.join(out, "facts")).count() == readings.count()
    # a batch that runs again replaces its own output
    state.merge_batch(readings.limit(50), 3, os.path.join(out, "state"))
    assert state.read_state(spark, os.path.join(out, "state")).count() == newest.count()


def test_scored_stream_and_tickets(spark, readings, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    with_score = readings.drop("category", "is_faulty", "fault_type").withColumnRenamed("confidence", "risk_score")
    stream = feed(spark, with_score, str(folder))
    s = F.col("risk_score")
    chance = F.array(1 - s, s * 0.4, s * 0.6)
    got = drain(live.scored(stream, chance), "scored", tmp_path)
    assert sorted(got.select("reading_id", "category", "fault_type").collect(), key=lambda r: r[0]) == sorted(
        live.scored(with_score, chance).select("reading_id", "category", "fault_type").collect(), key=lambda r: r[0])
    raised = drain(live.tickets(stream), "tickets", tmp_path)
    assert raised.count() == with_score.where("risk_score >= 0.8").count()
    total = drain(live.counters(live.scored(stream, chance)), "counters", tmp_path, "complete").first()
    assert total["processed"] == with_score.count() and total["critical"] == got.where("category = 'E'").count()


def test_model_in_the_stream(spark, readings, tmp_path):
    """Raw readings are scored inside the live loop, as the same model scores them in a batch."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    stats = spark.createDataFrame([(((50.0, 20.0), (45.0, 5.0)),)], "scaler struct<power: struct<mean: double, std: double>, temp: struct<mean: double, std: double>>")
    model = serving.RiskModel(serving.LinearModel([[1.0, -0.5], [0.0, 0.2], [-1.0, 0.7]], [0.1, 0.0, -0.1]), stats, ["power", "temp"], {})
    raw = readings.drop("category", "confidence", "is_faulty", "fault_type")
    live.run_live(feed(spark, raw, str(folder)), out, str(tmp_path / "cp"), {"availableNow": True}, model).awaitTermination(300)
    columns = ["reading_id", "category", "confidence", "fault_type"]
    got = spark.read.parquet(os.path.join(out, "facts")).select(columns).collect()
    assert sorted(got, key=lambda r: r[0]) == sorted(serving.score_readings(raw, model).select(columns).collect(), key=lambda r: r[0])
    messages = spark.read.parquet(os.path.join(out, "alerts")).where("type = 'critical'").select("message").collect()
    assert messages and all(" detected on INV-" in m[0] and not m[0].startswith("Fault detected") for m in messages)


def test_duplicates_in_stream(spark, readings, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    twice = readings.unionByName(readings.withColumn("reading_id", F.col("reading_id") + 10 ** 6))
    got = drain(live.unique_readings(feed(spark, twice, str(folder)), "40 days"), "unique", tmp_path)
    assert got.count() == readings.select("inverter_id", "ts").distinct().count()


def test_silent_devices(spark, tmp_path):
    minute = 60
    rows = [(1, 0), (2, 0), (1, 5 * minute), (1, 11 * minute), (1, 21 * minute), (2, 22 * minute), (1, 30 * minute), (1, 55 * minute)]
    df = spark.createDataFrame([(d, i, s) for i, (d, s) in enumerate(rows)], "inverter_id bigint, reading_id bigint, s bigint")
    df = df.select("inverter_id", "reading_id", F.timestamp_seconds(F.col("s") + 1_704_067_200).alias("ts"))
    folder = tmp_path / "in"
    folder.mkdir()
    got = drain(stale.connection_changes(feed(spark, df, str(folder), parts=len(rows))), "silent", tmp_path)
    seen = [(r["inverter_id"], (r["last_data_at"].timestamp() - 1_704_067_200) // minute, r["status"]) for r in got.collect()]
    mine = [s[1:] for s in seen if s[0] == 2]
    assert mine == [(0, "online"), (0, "offline"), (22, "online"), (22, "offline")]
    assert [s[1:] for s in seen if s[0] == 1] == [(0, "online"), (30, "offline"), (55, "online")]


@pytest.mark.parametrize("file_rows", [10_000, 40])
def test_events_of_many_files_are_batches_in_order(spark, tmp_path, monkeypatch, file_rows):
    """A table of several files, one of them all over the time line: five batches, each later than the one before, no row lost."""
    monkeypatch.setattr(bindings, "FILE_ROWS", file_rows)
    rows = spark.range(0, 3000, 1, 6).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") % 500 * 3600).alias("ts"),
                                             (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.5).alias("value"),
                                             F.lit('{"k": 3}').alias("props"))
    rows.write.parquet(f"{tmp_path}/in/events.parquet")
    seen = []
    stream = bindings.event_stream(spark, f"{tmp_path}/in", str(tmp_path / "root"))
    keep = lambda batch, _: seen.append(batch.agg(F.count("ts"), F.min("ts"), F.max("ts")).first())
    stream.writeStream.option("checkpointLocation", str(tmp_path / "check")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == bindings.STREAM_PARTS and sum(r[0] for r in seen) == 3000
    assert all(a[2] < b[1] for a, b in zip(seen, seen[1:]))
    assert spark.read.parquet(f"{tmp_path}/root/events").inputFiles().__len__() == (5 if file_rows > 100 else 5 * min(8, 6, rows.rdd.getNumPartitions()))
