"""Embeddings learnt from the texts: the leading right singular vectors of the weighted text-term matrix.

A text's row holds log(1 + count) * log(texts / texts with the term) for the terms of the vocabulary, the `VOCABULARY` terms
that most texts hold (ties by name), scaled to length 1. The singular vectors come from a randomised range finder: a block of
random directions is multiplied by A'A again and again and made orthogonal in between. Texts are split where their words are counted
and numbered, so no table of words is written. One multiplication is one pass over the
texts, which stay where they are, as numbers of their terms: each task adds up its share for every term, the shares of a term
meet as whole rows and are added up there, and the block - vocabulary times block width numbers, a size the parameters fix - is factorised on the driver and
sent to the next pass. A text, old or new, is embedded as its row times the vectors, scaled to length 1.

Missing or empty texts, and texts without a known term, have the zero vector.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terms with a dimension, components kept, further directions that sharpen them, multiplications by A'A.
VOCABULARY, COMPONENTS, SPARE, ROUNDS = 20_000, 64, 16, 5
SEED = 11
#: Entries that are multiplied at a time, entries of a term from which they are one product, bytes of text that are split at a time.
ENTRIES, MANY, TEXT_BYTES = 1 << 11, 16, 1 << 23
#: Terms of stretches of texts that a task holds before it adds up their counts.
TERMS = 2_000_000


@dataclass
class Latent:
    """Terms, their rarity, the singular vectors (term, component) and the singular values."""
    terms: list[str]
    rarity: np.ndarray
    vectors: np.ndarray
    values: np.ndarray


def _text(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column), F.lit("")))


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch whose last column is text, in slices of about `TEXT_BYTES`."""
    step = max(1, batch.num_rows * TEXT_BYTES // max(batch.column(batch.num_columns - 1).nbytes, 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Row of every word, and the words; separators are those of `chunks.words`. Texts that begin or end with one give an empty word there."""
    lists = pc.utf8_split_whitespace(texts)
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().dictionary_encode()


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, n) with the number of texts that hold the term, for stretches of texts."""
    met, count = [], 0

    def summed() -> pa.Table:
        return pa.concat_tables(met, promote_options="permissive").group_by("term", use_threads=False).aggregate([("n", "sum")]).rename_columns(["term", "n"])

    for batch in batches:
        for piece in _pieces(batch):
            row, found = _words(piece.column(0))
            size = len(found.dictionary)
            cell = np.sort(row * size + found.indices.to_numpy())
            cell = cell[np.append(True, cell[1:] != cell[:-1])] if len(cell) else cell
            n = np.bincount(cell % max(size, 1), minlength=size)
            met.append(pa.table({"term": found.dictionary, "n": pa.array(n, pa.int64())}))
            count += size
            if count > TERMS:
                met, count = [summed()], 0
                if len(met[0]) > TERMS // 2:
                    yield from met.pop().to_batches(max_chunksize=1 << 16)
    if met:
        yield from summed().to_batches(max_chunksize=1 << 16)


def places(texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of every occurrence of a known term."""
    row, found = _words(texts)
    numbers = pc.index_in(found.dictionary, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    at = numbers[found.indices.to_numpy()] if len(row) else np.zeros(0, np.int64)
    return row[at >= 0], at[at >= 0]


def weighted_rows(row: np.ndarray, term: np.ndarray, rows: int, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (row, term, weight) of the rows with these occurrences, ordered by row; rows have length 1."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    size = len(rarity)
    cell, count = np.unique(row.astype(np.int64) * size + term, return_counts=True)
    row, term = cell // size, cell % size
    weight = np.log1p(count) * rarity[term]
    length = np.sqrt(np.bincount(row, weight ** 2, rows))
    weight = np.divide(weight, length[row], out=np.zeros_like(weight), where=length[row] > 0)
    return row, term, weight


def _added(out: np.ndarray, to: np.ndarray, source: np.ndarray, of: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Add `weight` times the row `of` of `source` to the row `to` of `out`; `to` is sorted."""
    for start in range(0, len(to), ENTRIES):
        part = slice(start, start + ENTRIES)
        first = np.flatnonzero(np.append(True, to[part][1:] != to[part][:-1]))
        out[to[part][first]] += np.add.reduceat(source[of[part]] * weight[part, None], first)
    return out


def times(entries: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int, block: np.ndarray) -> np.ndarray:
    """The rows times a block (term, direction)."""
    row, term, weight = entries
    out, ends = np.zeros((rows, block.shape[1])), np.searchsorted(row, np.arange(rows + 1)).tolist()
    for i, (start, end) in enumerate(zip(ends, ends[1:])):
        if end > start:
            out[i] = weight[start:end] @ block[term[start:end]]
    return out


def back(entries: tuple[np.ndarray, np.ndarray, np.ndarray], right: np.ndarray, terms: int) -> np.ndarray:
    """The transposed rows times a block (row, direction)."""
    row, term, weight = entries
    # short numbers are ordered without comparing them
    order = np.argsort(term.astype(np.uint16) if terms <= 1 << 16 else term, kind="stable")
    row, term, weight = row[order], term[order], weight[order]
    count = np.bincount(term, minlength=terms)
    few = count[term] < MANY
    out = _added(np.zeros((terms, right.shape[1])), term[few], right, row[few], weight[few])
    ends = np.cumsum(count)
    for t in np.flatnonzero(count >= MANY):
        part = slice(ends[t] - count[t], ends[t])
        out[t] = weight[part] @ right[row[part]]
    return out


def _lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1), pa.float64()))


def _gathered(stored: DataFrame, share, rarity, rows: int, width: int) -> np.ndarray:
    """The sum over all tasks of matrices `share(entries, number of texts)`, by row."""
    def sent(total: np.ndarray) -> pa.RecordBatch:
        used = np.flatnonzero(total.any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), _lists(total[used])], names=["at", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, width))
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(0)
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                total += share(weighted_rows(row, lists.flatten().to_numpy(), len(lists), rarity.value), len(lists))
        yield sent(total)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, width))
        for batch in batches:
            if batch.num_rows:
                at = batch.column(0).to_numpy()
                order = np.argsort(at, kind="stable")
                _added(total, at[order], batch.column(1).flatten().to_numpy().reshape(-1, width), order, np.ones(len(at)))
        yield sent(total)

    parts = stored.mapInArrow(run, "at bigint, x array<double>")
    cells = parts.repartition("at").mapInArrow(met, "at bigint, x array<double>").toArrow()
    out = np.zeros((rows, width))
    if cells.num_rows:
        found = cells.combine_chunks()
        out[found.column("at").to_numpy()] = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width)
    return out


def fit(texts: DataFrame, folder: str, column: str = "chunk", components: int = COMPONENTS, vocabulary: int = VOCABULARY, rounds: int = ROUNDS,
        seed: int = SEED) -> Latent:
    """Learn from all texts, which are read three times; the numbers of their terms are stored below `folder` for the passes."""
    spark = texts.sparkSession
    lowered = texts.select(_text(column).alias("__text"))
    n = texts.count()
    each = lowered.mapInArrow(_held, "term string, n bigint").where("term <> ''")
    held = each.groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "term").limit(vocabulary).collect()
    terms, rarity = [r["term"] for r in held], np.log(n / np.array([r["n"] for r in held], float)) if held else np.zeros(0)
    width = min(components + SPARE, len(terms))
    if not width:
        return Latent(terms, rarity, np.zeros((0, 0)), np.zeros(0))
    names, shared_rarity = spark.sparkContext.broadcast(terms), spark.sparkContext.broadcast(rarity)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_terms = pa.array(names.value, pa.string())
        for batch in batches:
            for piece in _pieces(batch):
                row, term = places(piece.column(0), all_terms.cast(piece.column(0).type))
                ends = np.append(0, np.cumsum(np.bincount(row, minlength=piece.num_rows)))
                at = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(term, pa.int32()))
                yield pa.RecordBatch.from_arrays([at], names=["__at"])

    lowered.mapInArrow(known, "__at array<int>").write.mode("overwrite").parquet(os.path.join(folder, "places"))
    stored = spark.read.schema("__at array<int>").parquet(os.path.join(folder, "places"))

    def multiplied(block: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(block)

        def share(entries: tuple, n: int) -> np.ndarray:
            return back(entries, times(entries, n, shared.value), len(shared.value))
        return _gathered(stored, share, shared_rarity, len(terms), width)

    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(terms), width)))[0]
    for _ in range(rounds):
        block = np.linalg.qr(multiplied(block))[0]
    shared = spark.sparkContext.broadcast(block)

    def square(entries: tuple, n: int) -> np.ndarray:
        y = times(entries, n, shared.value)
        return y.T @ y

    small = _gathered(stored, square, shared_rarity, width, width)
    values, turned = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:components]
    return Latent(terms, rarity, block @ turned[:, order], np.sqrt(np.maximum(values[order], 0.0)))


def embed(texts: DataFrame, model: Latent, column: str = "chunk", out: str = "vector", keep: list[str] | None = None) -> DataFrame:
    """`texts`, or the columns `keep` of them, with a unit vector for each."""
    shared = texts.sparkSession.sparkContext.broadcast((model.terms, model.rarity, model.vectors))
    kept = texts if keep is None else texts.select(*keep)
    rows = texts.select(*[F.col(f"`{c}`") for c in kept.columns], _text(column).alias("__text"))
    schema = T.StructType(kept.schema.fields + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, rarity, vectors = shared.value
        all_terms = pa.array(terms, pa.string())
        for batch in batches:
            for piece in _pieces(batch):
                text = piece.column(piece.num_columns - 1)
                entries = weighted_rows(*places(text, all_terms.cast(text.type)), len(text), rarity)
                y = times(entries, len(text), vectors) if len(vectors) else np.zeros((len(text), 0))
                length = np.linalg.norm(y, axis=1, keepdims=True)
                y = np.divide(y, length, out=np.zeros_like(y), where=length > 0)
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], _lists(y)], names=[*piece.schema.names[:-1], out])

    return rows.mapInArrow(run, schema)


def save(model: Latent, spark: SparkSession, folder: str) -> None:
    about = {"values": model.values.tolist()}
    rows = [(i, t, float(r), v.tolist()) for i, (t, r, v) in enumerate(zip(model.terms, model.rarity, model.vectors))]
    spark.createDataFrame(rows, "at int, term string, rarity double, vector array<double>").write.mode("overwrite").parquet(os.path.join(folder, "latent"))
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(folder, "about"))


def load(spark: SparkSession, folder: str) -> Latent:
    rows = spark.read.parquet(os.path.join(folder, "latent")).orderBy("at").collect()
    values = np.array(json.loads(spark.read.text(os.path.join(folder, "about")).first()["value"])["values"])
    return Latent([r["term"] for r in rows], np.array([r["rarity"] for r in rows]), np.array([r["vector"] for r in rows]).reshape(len(rows), -1), values)
