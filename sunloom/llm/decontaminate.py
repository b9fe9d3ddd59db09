"""Benchmark passages in training documents.

Every benchmark item is cut into windows of `width` consecutive normalised words; an item of fewer words is one window.
The windows go to all tasks as a hash set, documents are scanned once, window hashes that hit are compared word by word,
and the words inside any verified occurrence are marked. No shuffle: rows stay where they were read.

The benchmark must be small: its normalised text is collected in one piece of checked size (`MOST_BYTES`). A larger one is
an error that says so; split it and call once per part.

Defined cases: null or empty texts have no words, so no hits. Null and empty items have no window; rows with one
item id, as text, are one item. Items with the same window all count. Input columns are kept;
one named like an output of `scanned` gives way to it, `clean` returns them all. An empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunloom.llm.common import ALNUM_WORDS, as_batch, fresh, lower_words, once, output_schema, replacing, slices, with_arrays

WIDTH = 10
MOST_BYTES = 128 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20


class Windows:
    """The benchmark's windows by length and hash, and the scan of a document."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.width, self.vocabulary = width, {}
        self.names = [name for name, _ in items]
        self.found: dict[int, dict[int, dict[tuple, list[int]]]] = {}
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words] for _, words in items]
        for item, ids in enumerate(coded):
            if not ids:
                continue
            length = min(width, len(ids))
            of_length = self.found.setdefault(length, {})
            for at, key in enumerate(self.hashes(np.array(ids, np.uint64), length).tolist()):
                same = of_length.setdefault(key, {})
                holders = same.setdefault(tuple(ids[at:at + length]), [])
                if not holders or holders[-1] != item:
                    holders.append(item)
        self.filters = {}
        for length, keys in self.found.items():
            table = np.zeros(1 << _FILTER_BITS, bool)
            table[np.array(list(keys), np.uint64) >> np.uint64(64 - _FILTER_BITS)] = True
            self.filters[length] = table

    @staticmethod
    def hashes(ids: np.ndarray, length: int) -> np.ndarray:
        """Polynomial hashes of all runs of `length` ids, by powers of an odd base modulo 2**64."""
        n = len(ids) - length + 1
        total = np.zeros(max(n, 0), np.uint64)
        for k in range(length if n > 0 else 0):
            total = total * _BASE + ids[k:k + n]
        return total * _BASE

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Per word whether a window covers it, and the items that have one."""
        covered, items = np.zeros(len(words) + 1, np.int32), set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))
        known = np.append(0, np.cumsum(ids > 0))
        for length, keys in self.found.items():
            if len(ids) < length:
                continue
            starts = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(starts):
                continue
            codes = ids[starts].copy()
            for k in range(1, length):
                codes = codes * _BASE + ids[starts + k]
            codes = codes * _BASE
            likely = self.filters[length][codes >> np.uint64(64 - _FILTER_BITS)]
            for at, key in zip(starts[likely].tolist(), codes[likely].tolist()):
                holders = keys.get(key, {}).get(tuple(ids[at:at + length].tolist()))
                if holders:
                    covered[at] += 1
                    covered[at + length] -= 1
                    items.update(holders)
        return np.cumsum(covered[:-1]) > 0, items


def benchmark_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> list[tuple[str, str | None]]:
    """Ids and texts of the benchmark on the driver, after its size is checked."""
    size = benchmark.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 16)).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"the benchmark has {size} bytes, more than {MOST_BYTES}: split it and call once per part")
    return [(str(i), t) for i, t in benchmark.select(item_id, text).collect()]


def scanned(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text: str = "text", item_id: str = "item_id",
            names: tuple[str, str, str] = ("n_words", "hit_spans", "hit_items")) -> DataFrame:
    """`docs` with n_words, hit_spans (first word, word after the last one, of every covered run) and hit_items (ids as text)."""
    items = benchmark_items(benchmark, item_id)
    key = ("windows", width, hashlib.sha256(repr(items).encode()).hexdigest())
    sent = docs.sparkSession.sparkContext.broadcast(items)
    kinds = ("bigint", "array<struct<start: bigint, stop: bigint>>", "array<string>")
    docs, schema = replacing(docs, list(zip(names, kinds)), text)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = once(key, lambda: Windows([(i, lower_words(t, ALNUM_WORDS)) for i, t in sent.value], width))
        for batch in batches:
            for part in slices(batch, at):
                counts, spans, hits = [], [], []
                for x in part.column(at).to_pylist():
                    words = lower_words(x, ALNUM_WORDS)
                    covered, found = windows.scan(words)
                    turns = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
                    counts.append(len(words))
                    spans.append([{"start": a, "stop": b} for a, b in turns.reshape(-1, 2).tolist()])
                    hits.append(sorted({windows.names[i] for i in found}))
                yield with_arrays(part, output_schema(schema), [counts, spans, hits])

    return docs.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, remove: str = "documents", text: str = "text",
          item_id: str = "item_id") -> DataFrame:
    """`docs` without contaminated documents, or with remove="spans" without the words of the hits.

    A removed span takes the characters from its first word to its last one; the rest of a text stays as it was.
    """
    names = tuple(fresh(docs.columns, n) for n in ("n_words", "hit_spans", "hit_items"))
    found = scanned(docs, benchmark, width, text, item_id, names)
    if remove == "documents":
        return found.where(F.size(names[1]) == 0).drop(*names)
    if remove != "spans":
        raise ValueError("remove is documents or spans")
    schema, at = docs.schema, docs.columns.index(text)
    spans_at = len(docs.columns) + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_without(t, s) if s else t for t, s in zip(batch.column(at).to_pylist(), batch.column(spans_at).to_pylist())]
            columns = list(batch.columns[:len(schema)])
            columns[at] = pa.array(texts, pa.string())
            yield as_batch(columns, output_schema(schema))

    return found.mapInArrow(cut, schema)


def _without(text: str, spans: list[dict]) -> str:
    """`text` without the words at `spans`; words are runs of bytes that `ALNUM_WORDS` leaves."""
    data = text.encode()
    word = np.frombuffer(data.translate(ALNUM_WORDS), np.uint8) != 32
    turns = np.flatnonzero(np.diff(np.concatenate(([0], word.view(np.int8), [0])))).reshape(-1, 2)
    out, at = [], 0
    for span in spans:
        out.append(data[at:turns[span["start"], 0]])
        at = turns[span["stop"] - 1, 1]
    return b"".join([*out, data[at:]]).decode()
