"""Forest, balancing, boosting and metrics against brute force and their defining properties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.learning import forest, metrics, neighbours, scale, serving, smote
from sunloom.operators import ranking

COLUMNS = ["a", "b"]


def test_folds_follow_the_rule():
    assert ranking.folds(22, 4) == [(8, 8, 12), (12, 12, 16), (16, 16, 20), (20, 20, 22)]
    assert ranking.folds(20, 4) == [(8, 8, 12), (12, 12, 16), (16, 16, 20)]
    sizes = [stop - start for _, start, stop in ranking.folds(23, 4, balanced=True)]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    for n in range(5, 60):
        for end, start, stop in ranking.folds(n, 4):
            assert end == start < stop <= n


def test_macro_metrics_fixture(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, predicted int")
    row = metrics.macro_metrics(df).first()
    assert [round(row[c], 4) for c in ("accuracy", "precision", "recall", "f1")] == [0.5, 0.4444, 0.5, 0.3889]


def test_auc_equals_pair_counting(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), [rng.choice([0.1, 0.25, 0.5, rng.random()]) for _ in range(3)]) for _ in range(300)]
    df = spark.createDataFrame(rows, "label int, s array<double>")

    def auc(c):
        pos, neg = [s[c] for y, s in rows if y == c], [s[c] for y, s in rows if y != c]
        return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))

    expected = sum(auc(c) for c in range(3)) / 3
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for ranges in (1, 7, int(before)):
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        assert abs(metrics.macro_auc(df, "s", 3).first()["auc"] - expected) < 1e-12
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert metrics.macro_auc(df.where("label < 2"), "s", 3).first()["auc"] is None


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, 2.0), (float("nan"), 5.0, 4.0)], "a double, b double, c double")
    scaler = scale.fit_scaler(df, ["a", "b", "c"])
    got = scale.scaled(df, scaler, ["a", "b", "c"]).collect()
    x = np.array([[1, 5, 0], [3, 5, 2], [0, 5, 4]], dtype=float)
    std = x.std(axis=0)
    std[std == 0] = 1
    assert np.allclose(np.array(got, dtype=float), (x - x.mean(axis=0)) / std)


def _points(spark, n, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    weight = [1] * n
    if copies:
        weight[0] = copies
    rows = [(i, [float(v) for v in x[i]], weight[i], i % 3 != 1) for i in range(n)]
    return x, weight, spark.createDataFrame(rows, "id bigint, x array<double>, weight bigint, is_query boolean")


@pytest.mark.parametrize("block", [40, 1000])
def test_neighbours_are_exact(spark, block):
    x, weight, df = _points(spark, 260, 5, copies=90)
    found = {}
    for r in neighbours.nearest(df, 4, block).collect():
        found.setdefault(r["id"], []).append((round(r["distance"], 6), r["weight"], r["rank"]))
    assert set(found) == {i for i in range(260) if i % 3 != 1}
    for i, hits in found.items():
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        expanded = sorted(v for j in range(260) for v in [d[j]] * (weight[j] - (1 if j == i else 0)))[:4]
        mine = [v for v, w, _ in sorted(hits, key=lambda h: h[2]) for _ in range(w)][:4]
        assert np.allclose(mine, expanded, atol=1e-5), (i, mine, expanded)


@pytest.mark.parametrize("block, asked", [(700, 16), (3000, 16), (300, 1)])
def test_neighbours_of_many_pieces_are_exact(spark, monkeypatch, block, asked):
    """Points on a coarse grid with equal distances, far from the origin, some alone; blocks of several pieces, groups of few askers."""
    monkeypatch.setattr(neighbours, "ASKED", asked)
    rng = np.random.default_rng(8)
    x = np.unique(np.vstack([np.round(rng.normal(size=(2200, 3)), 1), rng.normal(size=(300, 3)) * 30]), axis=0) + 1000.0
    weight = np.where(rng.random(len(x)) < 0.05, 3, 1)
    rows = [(i * 7 % len(x), [float(v) for v in x[i]], int(weight[i]), i % 5 != 1) for i in range(len(x))]
    assert len(x) % 7
    want = {}
    for i, (name, _, _, query) in enumerate(rows):
        if query:
            near = sorted((float(np.sqrt(((x[j] - x[i]) ** 2).sum())), rows[j][0], int(weight[j]) - (i == j)) for j in range(len(x)) if i != j or weight[j] > 1) \
                if i % 20 == 0 else None
            want[name] = near
    found = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "id bigint, x array<double>, weight bigint, is_query boolean").repartition(3), 4, block).collect():
        found.setdefault(r["id"], []).append((r["rank"], r["distance"], r["other"], r["weight"]))
    assert set(found) == set(want)
    for name, hits in found.items():
        assert sum(h[3] for h in hits) >= 4
        if want[name]:
            total = 0
            for (_, distance, other, much), best in zip(sorted(hits), want[name]):
                assert (other, much) == best[1:] and abs(distance - best[0]) < 1e-9
                total += much
                if total >= 4:
                    break


def test_a_block_is_not_sent_to_every_asker(spark):
    """Points on parallel lines: few ask another block, and the rows that meet them are the blocks', once (F14)."""
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.random(6000) * 50, rng.integers(0, 5, 6000), rng.integers(0, 4, 6000) * 2.0])
    tree = neighbours._halved(x[::10], 20)
    cell = neighbours._cell(x, tree)
    assert len(np.unique(cell)) >= 30 and np.bincount(cell).max() < 600
    rows = [(i, [float(v) for v in x[i]], 1, True) for i in range(len(x))]
    hits = neighbours.nearest(spark.createDataFrame(rows, "id bigint, x array<double>, weight bigint, is_query boolean").repartition(3), 3, 400)
    stored = max((p for p in hits.inputFiles() if "neighbours-" in p), key=len).rsplit("/", 1)[0]
    assert spark.read.parquet(stored).agg({"visits": "count"}).first()[0] == 6000
    assert spark.read.parquet(stored).selectExpr("sum(size(visits)) AS n").first()["n"] < 6000 * 2


@pytest.mark.parametrize("block", [16, 4096])
def test_balance(spark, block):
    rng = random.Random(11)
    rows = [(i, 0 if i < 120 else (1 if i < 157 else 2), rng.gauss(i % 5, 1), rng.gauss(0, 2)) for i in range(170)]
    rows += [(200 + i, 2, 1.5, 2.5) for i in range(20)]  # a heap of copies in the smallest class
    df = spark.createDataFrame(rows, "id bigint, y int, a double, b double")
    out = smote.balance(df, "y", COLUMNS, "id", block=block)
    counts = {(r["y"], r["is_synthetic"]): r["count"] for r in out.groupBy("y", "is_synthetic").count().collect()}
    assert counts == {(0, False): 120, (1, False): 37, (1, True): 83, (2, False): 33, (2, True): 87}
    again = smote.balance(df, "y", COLUMNS, "id", block=block)
    assert sorted(out.where("is_synthetic").select("y", "a", "b").collect()) == \
        sorted(again.where("is_synthetic").select("y", "a", "b").collect())
    for y in (1, 2):
        real = np.array([r[2:] for r in rows if r[1] == y])
        for p in out.where(f"is_synthetic and y = {y}").select("a", "b").toPandas().to_numpy():
            # on a segment between two rows of the class
            d = real[:, None, :] - real[None, :, :]
            t = ((p - real)[:, None, :] * -d).sum(axis=2) / np.maximum((d ** 2).sum(axis=2), 1e-30)
            t = np.clip(t, 0, 1)
            gap = np.abs(real[:, None, :] - t[..., None] * d - p).sum(axis=2).min()
            assert gap < 1e-6


def test_balance_leaves_tiny_classes(spark):
    df = spark.createDataFrame([(i, int(i == 0), float(i), 1.0) for i in range(9)], "id bigint, y int, a double, b double")
    assert smote.balance(df, "y", COLUMNS, "id").count() == 9


def test_missing_classes(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "y int, a double, b double")
    assert sorted(scale.add_missing_classes(df, "y", COLUMNS).collect()) == [(0, 0.0, 0.0), (1, 2.0, 3.0), (2, 0.0, 0.0)]


def test_forest_finds_planted_outliers(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(1200)] + [(5000 + i, 40.0 + i, -50.0) for i in range(6)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double")
    scored = forest.add_isolation(df, "id", COLUMNS, trees=60).collect()
    flagged = [r for r in scored if r["iso_forest_anomaly"] == 1]
    assert 0.04 < len(flagged) / len(scored) < 0.06
    lowest = sorted(scored, key=lambda r: r["iso_forest_score"])[:6]
    assert {r["id"] for r in lowest} == {5000 + i for i in range(6)}


def test_forest_plan_and_small_samples(spark):
    df = spark.range(100).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"))
    plan = forest.add_isolation(df, "id", COLUMNS, trees=7)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan  # the rows meet only the one-row bracket of the threshold
    sample = forest.tree_samples(df, COLUMNS, "id", 7, 256, 1, 100).groupBy("tree").agg(F.countDistinct("draw").alias("n"))
    assert [r["n"] for r in sample.collect()] == [100] * 7  # fewer rows than the sample: each tree gets all


def test_auc_of_crowded_scores(spark):
    rng = random.Random(6)
    rows = [(int(rng.random() < 0.4), 0.99995 + rng.randrange(3000) * 1e-8) for _ in range(3000)]
    rows = [(y, s + y * 4e-6) for y, s in rows]
    df = spark.createDataFrame([(y, [1 - s, s]) for y, s in rows], "label int, p array<double>")
    up, down = [s for y, s in rows if y], np.sort([s for y, s in rows if not y])
    won = sum(np.searchsorted(down, s) + (np.searchsorted(down, s, "right") - np.searchsorted(down, s)) / 2 for s in up)
    assert metrics.macro_auc(df, "p", 2).first()[0] == pytest.approx(won / len(up) / len(down), abs=1e-9)


def test_stored_models(spark, tmp_path):
    readings = spark.createDataFrame([(i, 40.0 + i, 500.0, 20.0 + i, 3.0, 10.0 * i, 0) for i in range(12)],
                                     "reading_id int, module_temp double, irradiation double, dc_voltage double, dc_current double, ac_power double, alarm_code int")
    stats = spark.createDataFrame([(((50.0, 20.0), (45.0, 5.0)),)], "scaler struct<power: struct<mean: double, std: double>, temp: struct<mean: double, std: double>>")
    linear = serving.LinearModel([[1.0, -0.5], [0.0, 0.2], [-1.0, 0.7]], [0.1, 0.0, -0.1])
    path = str(tmp_path / "linear")
    serving.save_model(serving.RiskModel(linear, stats, ["power", "temp"], {"a": 1}), path)
    back = serving.load_model(spark, path)
    assert back.params == {"a": 1} and back.columns == ["power", "temp"]
    for r in serving.score_readings(readings, back).collect():
        z = np.array([(r["ac_power"] - 50) / 20, (r["module_temp"] - 45) / 5])
        p = np.exp(np.array(linear.weights) @ z + linear.biases)
        p /= p.sum()
        assert r["probabilities"] == pytest.approx(list(p), abs=6e-5) and r["confidence"] == pytest.approx(p.max(), abs=6e-5)
        assert r["predicted_class"] == ["no_risk", "degradation_risk", "shutdown_risk"][int(p.argmax())]


def test_forest_constants_and_paths():
    assert forest.path_constant(1) == 0 and forest.path_constant(2) == 1
    assert abs(forest.path_constant(256) - (2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)) < 1e-9
    # one tree: x <= 5 ends at depth 1, others pass a second node
    model = np.array([[0, 0, 0, 5.0, 1, 2, 0], [0, 1, -1, 0, -1, -1, 1.0], [0, 2, 0, 9.0, 3, 4, 0],
                      [0, 3, -1, 0, -1, -1, 2.0], [0, 4, -1, 0, -1, -1, 2.0]])
    assert np.allclose(forest.path_scores(np.array([[4.0], [6.0], [10.0]]), forest.by_tree(model), 2.0), [-2 ** -0.5, -0.5, -0.5])


def test_samples_are_full(spark):
    """Every tree gets a full sample without repeats."""
    df = spark.range(3000).select("id", F.rand(1).alias("a"))
    sample = forest.tree_samples(df, ["a"], "id", 40, 64, 1, 3000).cache()
    sizes = [r["count"] for r in sample.groupBy("tree").count().collect()]
    assert len(sizes) == 40 and min(sizes) == 64 and max(sizes) == 64
    assert sample.dropDuplicates(["tree", "a"]).count() == sample.count()
