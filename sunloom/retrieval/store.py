"""A stored vector index: cells around centroids, short codes for a first pass, exact scores for what is left.

`build` writes unit vectors partitioned by cell. Centroids and code words are learnt by k-means from a sample of at most `SAMPLE`
vectors (the smallest hashes of the ids, so reruns agree); every vector is assigned to its nearest centroid and coded.

`search` asks the cells whose centroids are nearest to a query, as many as `build` found to hold `SURE` of the nearest neighbours
of sampled vectors: few where vectors gather around centroids, more than half of them where they spread evenly. Inside a cell vectors are ranked by their codes - the vector is
cut into parts, each part stands for its nearest code word, and a query needs one table of products per part - and the best
`RERANK` * k are scored in full. With `exact` the k-th score so far bounds what other cells can hold: a vector within the
angle r of its centroid has at most the cosine of (angle to the centroid - r). Cells above the bound are asked too, whole and without codes, so
the result is that of a full scan.

A cell that holds many vectors, copies of one for example, is cut into blocks of `BLOCK` rows; queries travel to each block, in
groups of `GROUP` queries. No group of rows grows with the table, and no pair table exists: a block emits k rows per query.
"""

from __future__ import annotations

import json
import math
import os
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors that centroids and code words are learnt from.
SAMPLE = 20_000
#: Rounds of k-means, most cells, code words of each part, components of a part.
ROUNDS, MOST_CELLS, WORDS, PART = 12, 4096, 32, 4
BLOCK = 50_000
#: Queries that meet a block at a time, and entries (query, cell) that a task makes at a time.
GROUP, ENTRIES = 4_096, 100_000
RERANK = 20
#: Sampled vectors whose neighbours tell how many cells to ask, and the share of the neighbours these cells must hold.
PROBED, SURE = 500, 0.97
EPSILON = 1e-9
#: Slack of bounds for rounding.
SLACK = 1e-6


def k_means(x: np.ndarray, k: int, seed: int = 7, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of the rows of x; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres ** 2).sum(axis=1) / 2).argmax(axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + EPSILON)


def _parts(width: int) -> list[slice]:
    return [slice(at, min(at + PART, width)) for at in range(0, width, PART)]


def encoded(x: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([nearest(x[:, part], book) for part, book in zip(_parts(x.shape[1]), words)]).astype(np.uint8)


@dataclass
class Store:
    """A stored index: unit centroids, code words, and per cell the number of vectors and the widest angle to the centroid."""
    spark: SparkSession
    folder: str
    centres: np.ndarray
    words: list[np.ndarray]
    counts: np.ndarray
    angles: np.ndarray
    key_type: str
    probes: int

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(f"item {self.key_type}, vector array<double>, code binary, angle double, cell int").parquet(
            os.path.join(self.folder, "vectors"))


def calibrated(sample: np.ndarray, centres: np.ndarray, k: int = 5) -> int:
    """Cells to ask: the first ones of a sampled vector hold `SURE` of its k nearest in the sample. The whole table is denser than
    the sample, so its neighbours are nearer and lie in no more cells."""
    asked, cell = sample[:PROBED], nearest(sample, centres)
    if len(sample) <= k:
        return len(centres)
    near = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, 1:k + 1]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    ranks = np.sort(np.take_along_axis(place, cell[near], axis=1).reshape(-1))
    return int(ranks[min(len(ranks) - 1, math.ceil(SURE * len(ranks)))]) + 1


def build(vectors: DataFrame, folder: str, key: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> Store:
    """Write the index of `vectors`. By default there are about 2 * sqrt(rows) cells, at most `MOST_CELLS`."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("item"), F.transform(vector, lambda v: v.cast("double")).alias("vector"))
    n = rows.count()
    held = rows.orderBy(F.xxhash64("item"), "item").limit(SAMPLE).select("vector").collect()
    if not held:
        raise ValueError("an index needs vectors")
    sample = unit(np.array([r["vector"] for r in held]))
    centres = unit(k_means(sample, cells or min(MOST_CELLS, max(1, math.ceil(2 * math.sqrt(n))))))
    words = [k_means(sample[:, part], WORDS) for part in _parts(sample.shape[1])]
    shared, kind = spark.sparkContext.broadcast((centres, words)), dict(vectors.dtypes)[key]

    def place(batches):
        middle, books = shared.value
        for batch in batches:
            if len(batch):
                x = unit(np.vstack(batch["vector"]))
                cell = nearest(x, middle)
                angle = np.arccos(np.clip((x * middle[cell]).sum(axis=1), -1.0, 1.0))
                yield pd.DataFrame({"item": batch["item"], "vector": list(x), "code": [c.tobytes() for c in encoded(x, books)],
                                    "angle": angle, "cell": cell.astype("int32")})

    placed = rows.mapInPandas(place, f"item {kind}, vector array<double>, code binary, angle double, cell int")
    # the rows of a cell lie together, so that it is one file and not one of every task; large cells are split
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(os.path.join(folder, "vectors"))
    store = Store(spark, folder, centres, words, np.zeros(len(centres), np.int64), np.zeros(len(centres)), kind, calibrated(sample, centres))
    # one row per cell
    for r in store.vectors().groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle")).toLocalIterator():
        store.counts[r["cell"]], store.angles[r["cell"]] = r["n"], r["angle"]
    about = {"centres": centres.tolist(), "words": [w.tolist() for w in words], "counts": store.counts.tolist(), "angles": store.angles.tolist(), "key": kind,
             "probes": store.probes}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(folder, "about"))
    return store


def load(spark: SparkSession, folder: str) -> Store:
    about = json.loads(spark.read.text(os.path.join(folder, "about")).first()["value"])
    return Store(spark, folder, np.array(about["centres"]), [np.array(w) for w in about["words"]], np.array(about["counts"]),
                 np.array(about["angles"]), about["key"], about["probes"])


def _asked(store: Store, queries: DataFrame, query: str, vector: str, probes: int, bound: bool, parts: int) -> DataFrame:
    """Rows (query, vector, cell, block, part): the cells each query has to ask, and the group of the query. With `bound`, those that
    `least` leaves open beyond the first."""
    shared = store.spark.sparkContext.broadcast((store.centres, store.counts, store.angles))
    blocks = np.maximum(1, -(-store.counts // BLOCK))
    kind = dict(queries.dtypes)[query]

    def choose(batches):
        centres, counts, angles = shared.value
        full = np.flatnonzero(counts)
        step = max(1, ENTRIES // max(len(full), int(blocks[full].sum())))
        for batch in (whole[at:at + step] for whole in batches for at in range(0, len(whole), step)):
            x = unit(np.vstack(batch["vector"]).astype("float64"))
            cosine = x @ centres[full].T
            order = np.argsort(-cosine, axis=1, kind="stable")
            take = np.zeros(cosine.shape, bool)
            np.put_along_axis(take, order[:, :probes], True, axis=1)
            if bound:
                gap = np.maximum(np.arccos(np.clip(cosine, -1, 1)) - angles[full] - SLACK, 0.0)
                take = ~take & (np.cos(gap) >= batch["least"].to_numpy()[:, None] - SLACK)
            row, column = np.nonzero(take)
            if not len(row):
                continue
            cell = full[column]
            times = blocks[cell]
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            yield pd.DataFrame({"query": batch["query"].to_numpy()[row], "vector": [x[i] for i in row], "cell": cell.astype("int32"),
                                "block": block.astype("int32"), "part": batch["part"].to_numpy()[row]})

    wanted = queries.select(F.col(query).alias("query"), F.transform(vector, lambda v: v.cast("double")).alias("vector"),
                            F.pmod(F.xxhash64(query), F.lit(parts)).cast("int").alias("part"), *(["least"] if bound else []))
    return wanted.mapInPandas(choose, f"query {kind}, vector array<double>, cell int, block int, part int")


def _hits(store: Store, asked: DataFrame, k: int, codes: bool, parts: int) -> DataFrame:
    """The k best vectors of each query in each block of its cells."""
    kind = dict(asked.dtypes)["query"]
    shared = store.spark.sparkContext.broadcast((store.words, np.maximum(1, -(-store.counts // BLOCK))))
    blocks = F.element_at(F.array(*[F.lit(int(b)) for b in np.maximum(1, -(-store.counts // BLOCK))]), F.col("cell") + 1)
    # only cells that a query asks are read: the join prunes partitions
    cells = asked.select("cell").distinct()
    rows = store.vectors().join(F.broadcast(cells), "cell").withColumn("block", F.pmod(F.xxhash64("item"), blocks).cast("int"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def score(vectors: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "item": [], "score": []}
        if len(vectors) and len(wanted):
            x = np.vstack(vectors["vector"])
            item = vectors["item"].to_numpy()
            _, by_item = np.unique(item, return_inverse=True)
            code = np.frombuffer(b"".join(vectors["code"]), np.uint8).reshape(len(x), -1) if codes else None
            for name, q in zip(wanted["query"], wanted["vector"]):
                near = np.arange(len(x))
                if codes and len(x) > RERANK * k:
                    rough = np.zeros(len(x))
                    for j, (part, book) in enumerate(zip(_parts(x.shape[1]), shared.value[0])):
                        rough += (book @ q[part])[code[:, j]]
                    near = np.argpartition(-rough, RERANK * k - 1)[:RERANK * k]
                full = np.round(x[near] @ q, 12)
                best = near[np.lexsort((by_item[near], -full))[:k]]
                out["query"] += [name] * len(best)
                out["item"] += item[best].tolist()
                out["score"] += np.round(x[best] @ q, 12).tolist()
        return pd.DataFrame(out)

    return rows.groupBy("cell", "block", "part").cogroup(asked.groupBy("cell", "block", "part")).applyInPandas(
        score, f"query {kind}, item {store.key_type}, score double")


def search(store: Store, queries: DataFrame, k: int = 5, probes: int | None = None, exact: bool = False, query: str = "query_id", vector: str = "embedding",
           folder: str | None = None) -> DataFrame:
    """Rows (query, item, score, rank), ties by item. `exact` stores the hits of the first cells in `folder`."""
    order, probes = Window.partitionBy("query").orderBy(F.desc("score"), "item"), probes or store.probes

    parts = max(1, math.ceil(queries.count() / GROUP))

    def best(hits: DataFrame) -> DataFrame:
        found = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        # k rows for each query of one group: what they are joined with need not move
        return found.hint("broadcast") if parts == 1 else found

    first = best(_hits(store, _asked(store, queries, query, vector, probes, False, parts), k, not exact, parts))
    if not exact:
        return first.withColumnRenamed("query", query)
    path = os.path.join(folder or store.folder, "first")
    first.drop("rank").write.mode("overwrite").parquet(path)
    first = store.spark.read.parquet(path)
    least = first.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(-2.0).alias("least"))
    open_queries = queries.join(least, F.col(query) == F.col("query"), "left").withColumn("least", F.coalesce("least", F.lit(-2.0))).drop("query")
    rest = _hits(store, _asked(store, open_queries, query, vector, probes, True, parts), k, False, parts)
    return best(first.unionByName(rest)).withColumnRenamed("query", query)
