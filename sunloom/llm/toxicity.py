"""Toxicity by a linear classifier on character n-grams, features scaled by naive Bayes log-count ratios.

A text is its lower-cased (A-Z) UTF-8 bytes between two blanks; its features are the distinct runs of 3 to 5 bytes, present or
not. An n-gram is its own number (base 257), so no two share a feature.

`fit` counts in how many toxic and clean training texts each n-gram stands, by a shuffle of counts added up per task. The
log-count ratio of an n-gram is r = log((p + 1) / (P + 2)) - log((q + 1) / (Q + 2)). The `FEATURES` n-grams with the largest
ratios against their standard errors become features with value r, and a logistic regression with an L2 penalty weighs them.
`scored` looks for these n-grams everywhere in every text, in one pass without a shuffle.

Training rows: all labelled rows up to `TRAIN_ROWS`; of more, a share chosen by a hash of the id, about `TRAIN_ROWS` rows. That is
what bounds the label table that is broadcast and the one task that runs the regression.

Defined cases: null text is empty text, whose score is that of no features. Rows without a label (or with a null one) are not
learned from, several labels of one id are several examples. Without training rows every score is 0.5, with one class only the
share of that class, smoothed. Repeated rows are scored each; input columns are kept, one named like the output gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.llm.common import SPACED_WORDS, forget, output_schema, replacing, slices, with_arrays

ORDERS = (3, 4, 5)
FEATURES = 4_096
TRAIN_ROWS = 20_000
#: Training texts an n-gram must stand in.
LEAST_TEXTS = 3
PENALTY = 1e-4
THRESHOLD = 0.3
_WINDOW = 1 << 20
_BITS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: Column) -> Column:
    """Rows that labels are never learned from; rows without an id are not among them."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4 == 2


def grams(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(order, number of the n-gram at each place) of bytes."""
    wide = data.astype(np.uint64)
    code = np.zeros(len(wide) + 1, np.uint64)
    for n in range(1, ORDERS[-1] + 1):
        if len(wide) < n:
            return
        code = code[:-1] * np.uint64(257) + wide[n - 1:]
        if n in ORDERS:
            yield n, code * np.uint64(8) + np.uint64(n)


def prepared(text: str | None) -> np.ndarray:
    return np.frombuffer(b" " + (text or "").encode().translate(SPACED_WORDS) + b" ", np.uint8)


def text_grams(text: str | None) -> np.ndarray:
    """Distinct n-grams of a text."""
    data, found = prepared(text), []
    for at in range(0, len(data), _WINDOW):
        found += [np.unique(code) for _, code in grams(data[at:at + _WINDOW + ORDERS[-1] - 1])]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


@dataclass
class Model:
    """n-grams in order, the log-odds each adds, and the log-odds of none."""
    keys: np.ndarray
    adds: np.ndarray
    bias: float

    def __post_init__(self):
        self.likely = np.zeros(1 << _BITS, bool)
        self.likely[self.keys * _SPREAD >> np.uint64(64 - _BITS)] = True

    def log_odds(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        if not len(self.keys):
            return out
        data = [prepared(t) for t in texts]
        end = np.cumsum([len(d) for d in data])
        joined = np.concatenate(data)
        pairs = []
        for at in range(0, len(joined), _WINDOW):
            for n, code in grams(joined[at:at + _WINDOW + ORDERS[-1] - 1]):
                code = code[:_WINDOW]
                place = np.flatnonzero(self.likely[code * _SPREAD >> np.uint64(64 - _BITS)])
                key = np.searchsorted(self.keys, code[place])
                key[key == len(self.keys)] = 0
                same = self.keys[key] == code[place]
                place, key = place[same] + at, key[same]
                text = np.searchsorted(end, place, side="right")
                inside = place + n <= end[text]  # not over the end of its text
                pairs.append(np.unique(text[inside] * len(self.keys) + key[inside]))
        pairs = np.unique(np.concatenate(pairs))
        return out + np.bincount(pairs // len(self.keys), self.adds[pairs % len(self.keys)], minlength=len(texts))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, label) of the training rows; labels of about TRAIN_ROWS rows at most are broadcast to the documents."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    total = usable.count()
    if total > TRAIN_ROWS:
        share = int(TRAIN_ROWS / total * 2**32)
        usable = usable.where(F.pmod(F.xxhash64(F.col(id_col).cast("bigint")), F.lit(2**32)) < share)
    few = usable.select(F.col(id_col).cast("bigint").alias("_label_id"), F.col(label_col).cast("int").alias("label"))
    return docs.select(F.col(id_col).cast("bigint").alias("_label_id"), F.col(text_col).alias("text")).join(F.broadcast(few), "_label_id").select("text", "label")


def log_count_ratios(train: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The FEATURES n-grams that tell the classes apart best, their log-count ratios, and the numbers of texts by class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in slices(batch, 0):
                found = [text_grams(t) for t in part.column(0).to_pylist()]
                toxic = np.repeat(part.column(1).to_numpy() > 0, [len(f) for f in found])
                keys, at = np.unique(np.concatenate(found), return_inverse=True)
                p, n = np.bincount(at, toxic, minlength=len(keys)), np.bincount(at, minlength=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(p.astype(np.int64)), pa.array(n - p.astype(np.int64))],
                                                 names=["key", "p", "q"])

    sizes = train.agg(F.coalesce(F.sum((F.col("label") > 0).cast("bigint")), F.lit(0)), F.count("*")).first()
    toxic, clean = int(sizes[0]), int(sizes[1] - sizes[0])
    if not toxic or not clean:
        return np.zeros(0, np.uint64), np.zeros(0), toxic, clean
    counts = train.mapInArrow(run, "key bigint, p bigint, q bigint").groupBy("key").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    ratio = F.log((F.col("p") + 1) / F.lit(toxic + 2.0)) - F.log((F.col("q") + 1) / F.lit(clean + 2.0))
    weight = F.abs("r") / F.sqrt(1 / (F.col("p") + 1) + 1 / (F.col("q") + 1))
    best = counts.where(F.col("p") + F.col("q") >= LEAST_TEXTS).withColumn("r", ratio).orderBy(F.desc(weight), "key").limit(FEATURES).select("key", "r").toPandas()
    keys = best["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], best["r"].to_numpy()[order], toxic, clean


def regression(offsets: np.ndarray, features: np.ndarray, ratios: np.ndarray, labels: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the mean logistic loss plus the penalty, by limited-memory BFGS.

    Row k has the features `features[offsets[k]:offsets[k + 1]]`, each with its ratio as value.
    """
    n, m = len(labels), len(ratios)
    row = np.repeat(np.arange(n), np.diff(offsets))
    value = ratios[features]

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, value * x[features], minlength=n) + x[m]
        miss = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels
        slope = np.append(np.bincount(features, value * miss[row], minlength=m) / n + PENALTY * x[:m], miss.mean())
        return (np.logaddexp(0, z) - labels * z).mean() + PENALTY / 2 * x[:m] @ x[:m], slope

    x = np.zeros(m + 1)
    x[m] = np.log((labels.sum() + 1) / (n - labels.sum() + 1))
    value_at, slope = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, alphas = slope.copy(), []
        for s, y in reversed(pairs):
            alphas.append(s @ way / (s @ y))
            way -= alphas[-1] * y
        way *= pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(np.abs(slope).sum(), 1e-12)
        for (s, y), alpha in zip(pairs, reversed(alphas)):
            way += (alpha - y @ way / (s @ y)) * s
        size = 1.0
        while size > 1e-8:
            new = x - size * way
            new_value, new_slope = loss(new)
            if new_value <= value_at - 1e-4 * size * (slope @ way):
                break
            size /= 2
        else:
            break
        if (new - x) @ (new_slope - slope) > 1e-12:
            pairs = (pairs + [(new - x, new_slope - slope)])[-8:]
        done = value_at - new_value < 1e-9
        x, value_at, slope = new, new_value, new_slope
        if done:
            break
    return x[:m], float(x[m])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    train = labelled(docs, labels, id_col, text_col, label_col)
    keys, ratios, toxic, clean = log_count_ratios(train)
    if not len(keys):
        return Model(keys, ratios, float(np.log((toxic + 1) / (clean + 1))))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in slices(batch, 0):
                found = [np.flatnonzero(np.isin(keys, text_grams(t), assume_unique=True)).tolist() for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(found, pa.list_(pa.int32()))], names=["label", "found"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held = [b for b in batches if b.num_rows]
        table = pa.Table.from_batches(held).combine_chunks()
        sets = table.column(1).combine_chunks()
        offsets = sets.offsets.to_numpy()
        weights, bias = regression(offsets - offsets[0], sets.flatten().to_numpy(), ratios, (table.column(0).to_numpy() > 0).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(weights) + 1)), pa.array(np.append(weights, bias))], names=["at", "weight"])

    # the bounded sample of training rows, as lists of features, meets in one task
    rows = train.mapInArrow(present, "label int, found array<int>").repartition(1).sortWithinPartitions("label", "found")
    weights = rows.mapInArrow(learn, "at bigint, weight double").orderBy("at").toPandas()["weight"].to_numpy()
    return Model(keys, ratios * weights[:-1], float(weights[-1]))


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the probability that a text is toxic."""
    docs, schema = replacing(docs, [(out, "double")], text_col)
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast((model.keys, model.adds, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own = Model(*sent.value)
        for batch in batches:
            for part in slices(batch, at):
                odds = np.clip(own.log_odds(part.column(at).to_pylist()), -500, 500)
                yield with_arrays(part, output_schema(schema), [1 / (1 + np.exp(-odds))])

    return docs.mapInArrow(run, schema)
