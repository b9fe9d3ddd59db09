"""Isolation forest: trees are grown on small seeded samples, rows are scored where they lie."""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

from sunloom import config
from sunloom.operators.quantiles import exact_quantiles
from sunloom.session import shared_folder

EULER = 0.5772156649015329
NODE = "tree int, node int, feature int, threshold double, left int, right int, depth_value double"


def path_constant(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def tree_samples(df: DataFrame, columns: list[str], key: str, trees: int, size: int, seed: int, total: int) -> DataFrame:
    """`size` rows per tree, or all rows when there are fewer, chosen by hash: reruns and retries agree.

    One scheme for tables of any size: a row gets `turns` draws for as many different trees, as many as twice the wanted
    rows need and at most one per tree; draws over the wanted share drop out before the shuffle, and the smallest draws
    of a tree win.
    """
    wanted = 2.0 * size * trees
    turns = max(1, min(trees, math.ceil(wanted / max(total, 1))))
    share = min(1.0, wanted / (max(total, 1) * turns))
    first = F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit("tree")), F.lit(trees))
    slots = F.transform(F.sequence(F.lit(0), F.lit(turns - 1)), lambda t: F.struct(
        F.pmod(first + t, F.lit(trees)).cast("int").alias("tree"), F.xxhash64(F.col(key), t, F.lit(seed)).alias("draw")))
    drawn = df.select(key, *columns, F.inline(slots)).where(F.pmod(F.col("draw"), F.lit(1 << 30)) < int((1 << 30) * share))
    order = Window.partitionBy("tree").orderBy("draw")
    return drawn.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("tree", "draw", *columns)


def grow(sample: np.ndarray, rng: np.random.Generator, depth_limit: int) -> list[tuple]:
    """Nodes of one tree: random feature, random cut, until a row is alone or the depth limit is met."""
    nodes: list[tuple] = []
    todo = [(sample, 0, None)]
    while todo:
        rows, depth, link = todo.pop()
        number = len(nodes)
        if link is not None:
            nodes[link[0]][link[1]] = number
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) else []
        if depth >= depth_limit or len(rows) <= 1 or len(spread) == 0:
            nodes.append([number, -1, 0.0, -1, -1, depth + path_constant(len(rows))])
            continue
        feature = int(rng.choice(spread))
        values = rows[:, feature]
        cut = float(rng.uniform(values.min(), values.max()))
        nodes.append([number, feature, cut, -1, -1, 0.0])
        todo.append((rows[values > cut], depth + 1, (number, 4)))
        todo.append((rows[values <= cut], depth + 1, (number, 3)))
    return nodes


def fit(df: DataFrame, columns: list[str], key: str, trees: int = config.FOREST_TREES, size: int = config.FOREST_SAMPLE,
        seed: int = config.SEED) -> tuple[np.ndarray, float]:
    """The node table, bounded by trees x 2 x size rows, and the scaling constant c(psi)."""
    filled = df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    total = df.count()
    psi = min(size, total)
    limit = math.ceil(math.log2(max(psi, 2)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        ordered = pdf.sort_values("draw")
        rng = np.random.default_rng([seed, tree])
        nodes = grow(ordered[columns].to_numpy("float64"), rng, limit)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "depth_value"])
        out.insert(0, "tree", tree)
        return out

    grown = tree_samples(filled, columns, key, trees, size, seed, total).groupBy("tree").applyInPandas(build, NODE)
    return grown.toPandas().sort_values(["tree", "node"]).to_numpy("float64"), path_constant(psi)


def by_tree(model: np.ndarray) -> list[np.ndarray]:
    """The node table cut into trees; its rows are ordered by tree and node."""
    return np.split(model, np.flatnonzero(np.diff(model[:, 0])) + 1)


def path_scores(x: np.ndarray, trees: list[np.ndarray], constant: float) -> np.ndarray:
    """-2^(-mean depth / c): the lower, the easier a row is isolated."""
    depth = np.zeros(len(x))
    for nodes in trees:
        feature, cut = nodes[:, 2].astype(int), nodes[:, 3]
        left, right, value = nodes[:, 4].astype(int), nodes[:, 5].astype(int), nodes[:, 6]
        at = np.zeros(len(x), dtype=int)
        moving = np.flatnonzero(feature[at] >= 0)
        while len(moving):
            here = at[moving]
            at[moving] = np.where(x[moving, feature[here]] <= cut[here], left[here], right[here])
            moving = moving[feature[at[moving]] >= 0]
        depth += value[at]
    return -np.power(2.0, -(depth / len(trees)) / constant)


def score(df: DataFrame, columns: list[str], model: np.ndarray, constant: float) -> DataFrame:
    """Adds `__raw`, the isolation score; only the inputs travel to Python, in batches."""
    shared = df.sparkSession.sparkContext.broadcast((model, constant))

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        nodes, c = by_tree(shared.value[0]), shared.value[1]
        for batch in batches:
            yield pd.Series(path_scores(np.column_stack([x.to_numpy("float64") for x in batch]), nodes, c))

    inputs = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    return df.withColumn("__raw", F.pandas_udf(run, "double", PandasUDFType.SCALAR_ITER)(*inputs))


def add_isolation(df: DataFrame, key: str, columns: list[str] | None = None, contamination: float = config.FOREST_CONTAMINATION,
                  trees: int = config.FOREST_TREES, size: int = config.FOREST_SAMPLE, seed: int = config.SEED,
                  fit_on: DataFrame | None = None) -> DataFrame:
    """iso_forest_score (lower is more anomalous) and a flag for the lowest `contamination` share.

    The scored table is stored once, for the threshold and for the result. `key` only drives the draws of the samples;
    nothing is joined.
    """
    columns = [c for c in columns or config.FOREST_SIGNALS if c in df.columns]
    if not columns:
        return df.withColumns({"iso_forest_score": F.lit(0.0), "iso_forest_anomaly": F.lit(0)})
    train = df if fit_on is None else fit_on
    model, constant = fit(train, columns, key, trees, size, seed)
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"forest-{uuid.uuid4().hex}")
    score(df, columns, model, constant).write.parquet(path)
    stored = spark.read.parquet(path)
    base = stored if fit_on is None else score(train.select(*columns), columns, model, constant)
    offset = exact_quantiles(base, ["__raw"], [contamination]).select("value").scalar()
    scored = stored.withColumn("iso_forest_score", F.col("__raw") - offset).drop("__raw")
    return scored.withColumn("iso_forest_anomaly", F.when(F.col("iso_forest_score") < 0, 1).otherwise(0))
