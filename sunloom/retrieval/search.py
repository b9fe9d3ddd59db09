"""Exact cosine top-k of queries over many vectors, and the context text built from the hits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom import config

# Queries of up to this many bytes travel to every task in one broadcast; more are cut into blocks of this size.
BLOCK_BYTES = 32 * 1024 * 1024
# Numbers in one score matrix, and bytes of vectors that meet a block of queries in one task.
MATRIX_CELLS = 4_000_000
BUCKET_BYTES = 64 * 1024 * 1024
EPSILON = 1e-9
# scores are rounded to 12 decimals; before, equal ones may differ by less than this
SLACK = 1e-11


class _Best:
    """The k best items per query of the vectors seen so far, as arrays."""

    def __init__(self, names: list, queries: np.ndarray, k: int):
        self.names, self.queries, self.k = names, queries, k
        self.norms = np.linalg.norm(queries, axis=1)
        self.query, self.score, self.item = np.zeros(0, np.int64), np.zeros(0), None
        # the k-th score of each query so far
        self.least = np.full(len(names), -np.inf)

    def add(self, items: np.ndarray, vectors: list) -> None:
        """Score items in slices, so that a score matrix stays within its bound."""
        step = max(1, MATRIX_CELLS // max(len(self.names), 1))
        for at in range(0, len(items), step):
            self._add(items[at:at + step], np.vstack(vectors[at:at + step]).astype("float64"))

    def _add(self, items: np.ndarray, x: np.ndarray) -> None:
        cosine = (self.queries @ x.T) / (self.norms[:, None] * np.linalg.norm(x, axis=1) + EPSILON)
        if len(items) > self.k:
            least = self.least
            if np.isinf(least).any():
                least = np.maximum(least, np.partition(cosine, len(items) - self.k, axis=1)[:, len(items) - self.k])
            # all that reach the k-th score of their query: ties are settled by item below
            query, row = np.nonzero(cosine >= (least - SLACK)[:, None])
        else:
            query, row = np.indices(cosine.shape).reshape(2, -1)
        if not len(row):
            return
        score = np.append(self.score, np.round(cosine[query, row], 12))
        query, item = np.append(self.query, query), items[row]
        item = item if self.item is None else np.append(self.item, item)
        _, by_item = np.unique(item, return_inverse=True)
        order = np.lexsort((by_item, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.least[query[last]] = np.where(np.isnan(score[order[last]]), -np.inf, score[order[last]])
        order, query = order[place < self.k], query[place < self.k]
        self.query, self.score, self.item = query, score[order], item[order]

    def hits(self):
        if self.item is not None:
            yield pd.DataFrame({"query": np.array(self.names, object)[self.query], "item": self.item, "score": self.score})


def _broadcast_hits(rows: DataFrame, ids: list, matrix: np.ndarray, k: int, schema: str) -> DataFrame:
    """All queries in one broadcast of checked size; every vector is scored, only winners leave a task."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, matrix))

    def score(batches):
        best = _Best(*shared.value, k)
        for batch in batches:
            if len(batch):
                best.add(batch["item"].to_numpy(), batch["vector"].tolist())
        yield from best.hits()

    return rows.mapInPandas(score, schema)


def _block_hits(rows: DataFrame, asked: DataFrame, blocks: int, width: int, k: int, schema: str) -> DataFrame:
    """Blocks of queries meet buckets of vectors as groups of bounded size; queries stay distributed, vectors are read once."""
    buckets = max(1, math.ceil(rows.count() * max(width, 1) * 8 / BUCKET_BYTES))

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = rows.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)).cast("int")).withColumn("block", numbers(blocks))
    right = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn("bucket", numbers(buckets))

    def score(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query": [], "item": [], "score": []})
        best = _Best(queries["query"].tolist(), np.vstack(queries["vector"].tolist()).astype("float64"), k)
        best.add(vectors["item"].to_numpy(), vectors["vector"].tolist())
        return next(best.hits())

    return left.groupBy("bucket", "block").cogroup(right.groupBy("bucket", "block")).applyInPandas(score, schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = config.RETRIEVE_K, key: str = "vec_id",
          vector: str = "embedding", query: str = "query_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (query, item, score, rank): the k most similar vectors of each query, ties by item.

    No pair table is built. The query side is measured: a small one is broadcast, a large one is dealt in blocks.
    """
    size = queries.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    blocks = max(1, math.ceil((size[0] or 0) * (size[1] or 0) * 8 / block_bytes))
    kind, item_kind = dict(queries.dtypes)[query], dict(vectors.dtypes)[key]
    schema = f"query {kind}, item {item_kind}, score double"
    rows = vectors.select(F.col(key).alias("item"), F.col(vector).alias("vector"))
    asked = queries.select(F.col(query).alias("query"), F.col(vector).alias("vector"))
    if blocks == 1:
        held = asked.collect()
        matrix = np.array([list(r["vector"]) for r in held], dtype="float64").reshape(len(held), -1)
        hits = _broadcast_hits(rows, [r["query"] for r in held], matrix, k, schema) if held else vectors.sparkSession.createDataFrame([], schema)
    else:
        hits = _block_hits(rows, asked, blocks, size[1] or 0, k, schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    best = (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(F.col("query").alias(query), F.col("item").alias(key), "score", "rank"))
    # k rows for each query of one broadcast: what they are joined with need not move
    return best.hint("broadcast") if blocks == 1 else best


def cosine(a: Column, b: Column) -> Column:
    """Similarity of two vector columns of one row."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + EPSILON)


def context_text(hits: DataFrame, query: str, text: str = "chunk", first: int = 3,
                 fallback: str = "No inverter-manual context available.", queries: DataFrame | None = None) -> DataFrame:
    """The first hits of each query as one text; queries without hits get the fallback."""
    top = hits.where(F.col("rank") <= first).groupBy(query).agg(F.sort_array(F.collect_list(F.struct("rank", text))).alias("h"))
    joined = top.select(query, F.array_join(F.transform("h", lambda h: h[text]), "\n---\n").alias("context"))
    if queries is None:
        return joined
    return queries.select(query).join(joined, query, "left").withColumn("context", F.coalesce("context", F.lit(fallback)))
