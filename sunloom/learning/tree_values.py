"""Exact Shapley values of boosted trees: what each input adds to a class's margin, on average over all orders of inputs.

An unknown input sends a row both ways, in proportion to the covers of the two children. For one leaf only the inputs on its
path matter. Each of these has a share z, the product of the cover shares of its splits on the path, and a row either takes
all of them (o = 1) or not (o = 0). With the weight of a set of s out of d inputs being s! (d - 1 - s)! / d!, the leaf gives
input i its value times (o_i - z_i) times the weighted sum over all sets of the others of the product of their o or z.
That sum is a polynomial: one factor (z_j + o_j t) is multiplied in per input (`extended`), and the one of input i is taken
out again (`unwound`), so the work per leaf is quadratic in d instead of exponential. Rows that take the same splits of a
leaf share the result. A tree tells the bins of an input apart only by its own cuts: once a task has seen more rows than there are
combinations of such stretches of bins, the tree's values are worked out once per combination and looked up for the rows.

Values plus `bias`, the cover-weighted mean of the leaves, add up to the margin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunloom import config
from sunloom.learning.boosting import Boosted, _arrow_types, _inputs
from sunloom.learning.histogram_trees import Tree


#: Inputs on a path up to which a leaf keeps a table of all patterns of taken splits.
TABLE_INPUTS = 8
#: Numbers that the tables of whole trees may hold in a task.
TABLE_NUMBERS = 8_000_000


def extended(weights: np.ndarray, taken: np.ndarray, share: float) -> np.ndarray:
    """Coefficients by the number of known inputs, with one more input; rows are patterns of taken splits."""
    out = np.zeros((len(weights), weights.shape[1] + 1))
    out[:, :-1] = weights * share
    out[:, 1:] += weights * taken[:, None]
    return out


def unwound(weights: np.ndarray, taken: np.ndarray, share: float) -> np.ndarray:
    """Coefficients without one of the inputs. Where its splits are taken (factor share + t) from the top, else by division."""
    d = weights.shape[1] - 1
    out = np.zeros((len(weights), d))
    on = taken > 0
    carry = np.zeros(int(on.sum()))
    for k in range(d - 1, -1, -1):
        carry = weights[on, k + 1] - carry * share
        out[on, k] = carry
    if share > 0:
        out[~on] = weights[~on, :-1] / share
    return out


def set_weights(d: int) -> np.ndarray:
    """s! (d - 1 - s)! / d! for s = 0 .. d - 1."""
    out = np.empty(d)
    out[0] = 1.0 / d
    for s in range(1, d):
        out[s] = out[s - 1] * s / (d - s)
    return out


class Leaf:
    """A leaf's value, and per input on its path the bounds of its bins (above low, at most high) and its share."""

    __slots__ = ("value", "features", "low", "high", "share", "table")

    def __init__(self, value: float, path: dict[int, tuple[float, float, float]]):
        self.value, self.features = value, sorted(path)
        self.low, self.high, self.share = (np.array([path[f][i] for f in self.features]) for i in range(3))
        self.table: np.ndarray | None = None

    def add(self, bins: np.ndarray, values: np.ndarray) -> None:
        """Add this leaf's part to the values (row, input)."""
        d = len(self.features)
        if not d:
            return
        if d <= TABLE_INPUTS:
            if self.table is None:
                self.table = self._given((np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float))
            code = np.zeros(len(bins), np.int64)
            for j, feature in enumerate(self.features):
                own = bins[:, feature]
                code += ((own > self.low[j]) & (own <= self.high[j])).astype(np.int64) << j
            for j, feature in enumerate(self.features):
                values[:, feature] += self.table[:, j][code]
            return
        own = bins[:, self.features]
        taken = (own > self.low) & (own <= self.high)
        if d <= 62:
            code = taken @ (1 << np.arange(d, dtype=np.int64))
            _, first, of = np.unique(code, return_index=True, return_inverse=True)
            patterns = taken[first].astype(float)
        else:
            patterns, of = np.unique(taken, axis=0, return_inverse=True)
            patterns = patterns.astype(float)
        values[:, self.features] += self._given(patterns)[of.reshape(-1)]

    def _given(self, patterns: np.ndarray) -> np.ndarray:
        """What the leaf gives its inputs, for each pattern of taken splits."""
        d = len(self.features)
        weights = np.ones((len(patterns), 1))
        for j in range(d):
            weights = extended(weights, patterns[:, j], self.share[j])
        given, size = np.empty((len(patterns), d)), set_weights(d)
        for j in range(d):
            if self.share[j] > 0:
                rest = unwound(weights, patterns[:, j], self.share[j])
            else:
                # no training row took these splits: the factor is t where taken, and nothing else
                rest = np.where(patterns[:, j:j + 1] > 0, weights[:, 1:], self._without(patterns, j))
            given[:, j] = rest @ size * (patterns[:, j] - self.share[j]) * self.value
        return given

    def _without(self, patterns: np.ndarray, gone: int) -> np.ndarray:
        weights = np.ones((len(patterns), 1))
        for j in range(len(self.features)):
            if j != gone:
                weights = extended(weights, patterns[:, j], self.share[j])
        return weights


def leaves_of(tree: Tree) -> list[Leaf]:
    out, todo = [], [(0, {})]
    while todo:
        node, path = todo.pop()
        feature = tree.feature[node]
        if feature < 0:
            out.append(Leaf(tree.value[node], path))
            continue
        low, high, share = path.get(feature, (-1.0, np.inf, 1.0))
        for child, bounds in ((tree.left[node], (low, min(high, tree.bin[node]))), (tree.left[node] + 1, (max(low, tree.bin[node]), high))):
            part = tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.0
            todo.append((child, path | {feature: (*bounds, share * part)}))
    return out


def bias_of(leaves: list[Leaf]) -> float:
    return float(sum(leaf.value * leaf.share.prod() for leaf in leaves))


def shapley(leaves: list[Leaf], bins: np.ndarray) -> np.ndarray:
    # inputs lie in a row each, as leaves read and add to whole columns
    bins, values = np.asfortranarray(bins), np.zeros(bins.shape, order="F")
    for leaf in leaves:
        leaf.add(bins, values)
    return np.ascontiguousarray(values)


class Values:
    """Adds the Shapley values of a tree, by its leaves or from a table of all combinations of the stretches of bins that it tells apart."""

    def __init__(self, tree: Tree):
        self.leaves, self.seen, self.table = leaves_of(tree), 0, None
        self.cuts = {f: np.unique([b for g, b in zip(tree.feature, tree.bin) if g == f]) for f in sorted({f for f in tree.feature if f >= 0})}
        self.combinations = math.prod(len(cuts) + 1 for cuts in self.cuts.values())

    def add(self, cells: np.ndarray, values: np.ndarray, room: int) -> int:
        """Add to the values (input, row) of the bins (input, row). Returns how many of `room` numbers a new table took."""
        self.seen += cells.shape[1]
        took = 0
        if self.table is None and self.seen >= self.combinations and self.combinations * len(self.cuts) <= room:
            took = self._tabled(len(cells))
        if self.table is None:
            for leaf in self.leaves:
                leaf.add(cells.T, values.T)
            return took
        code = sum(steps.take(cells[f]) for f, steps in self.steps.items())
        for f, given in self.table.items():
            values[f] += given.take(code)
        return took

    def _tabled(self, inputs: int) -> int:
        bins, stretch = np.zeros((inputs, self.combinations), np.uint8), 1
        self.steps, number = {}, np.arange(self.combinations)
        for f, cuts in self.cuts.items():
            bins[f] = np.append(cuts, 255)[number // stretch % (len(cuts) + 1)]
            self.steps[f] = np.searchsorted(cuts, np.arange(256)) * stretch
            stretch *= len(cuts) + 1
        given = np.zeros(bins.shape)
        for leaf in self.leaves:
            leaf.add(bins.T, given.T)
        self.table = {f: given[f].copy() for f in self.cuts}
        return self.combinations * len(self.cuts)


# ----------------------------------------------------------------------------------------------------------- operators
def attributions(model: Boosted, df: DataFrame, *keep: str) -> DataFrame:
    """Rows (keep..., class, bias, entries) for every row and class; entries are {feature, value} in input order."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = df.select(*keep)
    schema = T.StructType(kept.schema.fields + T._parse_datatype_string("class int, bias double, values array<double>").fields)
    arrow = pa.schema([*_arrow_types(kept), ("class", pa.int32()), ("bias", pa.float64()), ("values", pa.list_(pa.float64()))])
    wide, count = len(kept.columns), len(model.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = [[Values(trees[c]) for trees in shared.value.rounds] for c in range(shared.value.classes)]
        biases = [bias_of([leaf for tree in trees for leaf in tree.leaves]) for trees in forest]
        room = TABLE_NUMBERS
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cells = shared.value.cells([batch.column(wide + j).to_numpy() for j in range(count)])
            for c, trees in enumerate(forest):
                values = np.zeros(cells.shape)
                for tree in trees:
                    room -= tree.add(cells, values, room)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * count, pa.int32()), pa.array(np.ascontiguousarray(values.T).reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:wide], pa.array(np.full(n, c), pa.int32()), pa.array(np.full(n, biases[c])), rows],
                                                 schema=arrow)

    inputs = [c.alias(f"__{i}") for i, c in enumerate(_inputs(model.columns))]
    walked = df.select(*[F.col(k) for k in keep], *inputs).mapInArrow(run, schema)
    names = F.array(*[F.lit(c) for c in model.columns])
    entries = F.transform(F.arrays_zip(names.alias("feature"), F.col("values").alias("value")), lambda e: F.struct(
        e["feature"].alias("feature"), e["value"].alias("value")))
    return walked.select(*keep, "class", "bias", entries.alias("entries"))


def _map(entries: Column, places: int = 6) -> Column:
    return F.map_from_arrays(F.transform(entries, lambda e: e["feature"]), F.transform(entries, lambda e: F.round(e["value"], places)))


def explanations(attributed: DataFrame, keys: list[str], predicted: str = "predicted", top: int = 5, places: int = 6) -> DataFrame:
    """One row per reading out of its rows per class: what made the model predict its class.

    top_features {feature, shap_value, abs_shap, rank}: the largest of the predicted class, equal sizes by name; all_values:
    the values of that class above 1e-6, by feature; class_values: values by feature for each class name.
    `attributed` must carry the column `predicted`.
    """
    names = F.array(*[F.lit(n) for n in config.CLASS_NAMES])
    named = F.struct(F.col("class").alias("class"), F.element_at(names, F.col("class") + 1).alias("name"), F.col("entries").alias("entries"))
    rows = attributed.groupBy(*keys, predicted).agg(F.sort_array(F.collect_list(named)).alias("__all"))
    own = F.filter("__all", lambda a: a["class"] == F.col(predicted))[0]["entries"]
    sized = F.transform(own, lambda e: F.struct((-F.abs(e["value"])).alias("size"), e["feature"].alias("feature"), e["value"].alias("value")))
    largest = F.slice(F.sort_array(sized), 1, top)
    ranked = F.transform(largest, lambda e, i: F.struct(e["feature"].alias("feature"), F.round(e["value"], places).alias("shap_value"),
                                                        F.round(-e["size"], places).alias("abs_shap"), (i + 1).alias("rank")))
    return rows.select(*keys, predicted, ranked.alias("top_features"), _map(F.filter(own, lambda e: F.abs(e["value"]) > 1e-6)).alias("all_values"),
                       F.map_from_arrays(F.transform("__all", lambda a: a["name"]), F.transform("__all", lambda a: _map(a["entries"], places))).alias("class_values"))
