"""Long series cut into slices must give what plain windows give."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sunloom.operators import features, labels, quantiles, ranking, series

KEYS = ["k"]


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds a third of the rows; times repeat and some values are missing."""
    rng = random.Random(7)
    data = []
    for i in range(1500):
        key = 0 if i % 3 == 0 else rng.randrange(1, 40)
        data.append((i, key, 1_700_000_000 + rng.randrange(4000) * 7, rng.choice([None, rng.uniform(-5, 900)]),
                     rng.choice([0, 0, 8, 464]), rng.uniform(0, 400), rng.choice([0, 5120, 5120, 7])))
    df = spark.createDataFrame(data, "id bigint, k int, s bigint, v double, alarm_code int, power double, op_state int")
    return df.withColumn("ts", F.timestamp_seconds("s")).cache()


def collected(df, *columns):
    return sorted(df.select("id", *columns).collect())


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all((p is None and q is None) or (p is not None and q is not None and abs(p - q) < 1e-6)
                   for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("limit", [40, 100])
def test_positions(rows, limit):
    plain = series.positions(rows, KEYS, "ts", "id", limit=10 ** 6)
    assert series.long_series(rows, KEYS, limit) is not None
    assert collected(series.positions(rows, KEYS, "ts", "id", limit=limit), "pos") == collected(plain, "pos")


def test_bounded_frames_in_slices(rows):
    def step(frame, part):
        w = Window.partitionBy(*part).orderBy("ts", "id")
        return frame.withColumns({"m": F.avg("v").over(w.rowsBetween(-6, 0)), "l": F.lag("power", 9).over(w),
                                  "a": F.max("power").over(w.rowsBetween(0, 5))})

    plain = series.over_series(rows, KEYS, "ts", "id", step, 9, 5, limit=10 ** 6)
    cut = series.over_series(rows, KEYS, "ts", "id", step, 9, 5, limit=33)
    close(collected(cut, "m", "l", "a"), collected(plain, "m", "l", "a"))


def test_fill_and_streak_in_slices(rows):
    close(collected(series.fill_forward(rows, KEYS, "ts", "id", ["v"], limit=29), "v"),
          collected(series.fill_forward(rows, KEYS, "ts", "id", ["v"], limit=10 ** 6), "v"))
    flagged = rows.withColumn("alarm_active", (F.col("alarm_code") != 0).cast("int"))
    assert collected(features.alarm_streak(flagged, KEYS, "ts", "id", limit=31), "alarm_streak") == \
        collected(features.alarm_streak(flagged, KEYS, "ts", "id", limit=10 ** 6), "alarm_streak")


def test_labels_in_slices(rows):
    out = [collected(labels.add_labels(rows, KEYS, "ts", "id", rows=17, limit=n), "risk_label") for n in (25, 10 ** 6)]
    assert out[0] == out[1] and {r[1] for r in out[0]} == {0, 1, 2}


def test_labels_are_forward_maxima(rows):
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(0, 16)
    marked = rows.withColumns(labels.events(rows))
    naive = marked.withColumn("risk_label", labels.risk_label(F.max("shutdown_event").over(w), F.max("degradation_event").over(w)))
    assert collected(labels.add_labels(rows, KEYS, "ts", "id", rows=17), "risk_label") == collected(naive, "risk_label")


@pytest.mark.parametrize("n", [2, 5, 48])
def test_wide_frames_equal_narrow(rows, n):
    names = [f"{s}_{a}_x" for s in ("v", "power") for a in ("rmean", "rstd", "rmin", "rmax")]
    a, b = (features.rolling(rows, KEYS, ["ts", "id"], ["v", "power"], {"x": n}, "x", wide=w) for w in (1, 10 ** 6))
    close(collected(a, *names), collected(b, *names))


def test_thin_out_in_slices(rows):
    a, b = (series.thin_out(rows, KEYS, "ts", "id", 20, limit=n) for n in (37, 10 ** 6))
    assert collected(a, "pos") == collected(b, "pos")


def test_global_positions(rows):
    pos = ranking.chronological(rows, "ts", "id")
    assert [r[0] for r in pos.orderBy("ts", "id").select("pos").collect()] == list(range(1500))


def test_global_positions_of_crowded_times(spark):
    """All rows in one second, half of them at the same time: ranges still share them out."""
    start = 1_704_067_200_000_000
    rows = spark.range(4000).select("id", F.timestamp_micros(F.lit(start) + F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id"))).alias("ts"))
    pos = ranking.chronological(rows.repartition(3), "ts", "id")
    assert [r[0] for r in pos.orderBy("ts", "id").select("pos").collect()] == list(range(4000))
    dealt = series.ranged(rows, ["ts", "id"], "t").groupBy("__part").count().agg(F.max("count"), F.count("*")).first()
    assert dealt[0] <= 2 * 4000 / dealt[1]


@pytest.mark.parametrize("accuracy", [20, 200, 10_000])
def test_quantiles_are_exact(rows, accuracy):
    pdf = rows.where("v is not null").toPandas()
    probabilities = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {(r["column"], r["p"]): r["value"] for r in
           quantiles.exact_quantiles(rows, ["v", "power", "alarm_code"], probabilities, accuracy=accuracy).collect()}
    full = rows.toPandas()
    for p in probabilities:
        assert abs(got["v", p] - pdf["v"].quantile(p)) < 1e-9
        assert abs(got["power", p] - full["power"].quantile(p)) < 1e-9
        assert abs(got["alarm_code", p] - full["alarm_code"].quantile(p)) < 1e-9
    near = {(r["k"], r["p"]): r["value"] for r in
            quantiles.exact_quantiles(rows, ["power"], [0.5, 0.95], ["k"], "nearest", accuracy).collect()}
    for key, group in full.groupby("k"):
        ordered = sorted(group["power"])
        assert near[key, 0.5] == ordered[len(ordered) // 2]
        assert near[key, 0.95] == ordered[int(len(ordered) * 0.95)]


def test_rows_of_a_task_do_not_grow_with_the_series(spark):
    """Slices of long series lie in as many partitions as there are slices; they are not merged into one per core."""
    limit = 100
    rows = spark.range(6_000).selectExpr("cast(id % 3 AS string) AS device", "timestamp_seconds(id * 60) AS ts", "id AS row_id")
    placed = series.over_series(rows, ["device"], "ts", "row_id", lambda frame, part: frame.withColumn("task", F.spark_partition_id()), behind=2, limit=limit)
    filled = series.fill_forward(placed, ["device"], "ts", "row_id", {"last": F.col("row_id")}, limit=limit)
    assert filled.where("last = row_id").count() == 6_000
    tasks = [r["n"] for r in placed.groupBy("task").agg(F.count("*").alias("n")).collect()]
    assert len(tasks) > 30 and max(tasks) <= 8 * limit, tasks
