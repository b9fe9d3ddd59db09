"""Periodic runs of words by the dictionary of basic factors.

A run is a stretch of words that repeats with a smallest period and that no neighbouring word extends; here it must hold at
least `TIMES` periods and `LEAST` words. `detected` returns all runs of every text, and the text with each run cut to its
first period.

For each power of two L, all factors of L words get numbers such that equal factors have equal numbers: level 1 numbers the
words of a document, level 2L the pairs of numbers L words apart. For each place the next occurrence of its factor within 2L
words is taken; equal occurrences at equal distance form arithmetic progressions, and stretches of neighbouring places with
one distance propose it as a period. A run of period q is found on the level with q <= L < 2q: there every place of the run
up to its last q + L words sees its factor again exactly q words on, as a nearer one would give the run a smaller period.
Proposals are extended word by word and those of several levels merged. Places whose factor occurs once are dropped from
level to level, so ordinary text is done after a few levels.

Row-wise: no shuffle. All documents of a slice of a batch are worked on in one go, each with word numbers of its own. Memory
is about 150 bytes per word of the slice (`SLICE_BYTES` of text, or one text that is longer).

Defined cases: null text is empty text: no words, no runs, an empty collapsed text. Rows and carried columns are kept,
repeated rows included; a carried column named like an output gives way to it. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunloom.llm.common import fresh, output_schema, replacing, slices

#: Words and periods a run must hold.
LEAST, TIMES = 6, 4
SLICE_BYTES = 2 << 20

_OUT = [("runs", "array<struct<start: bigint, length: bigint, period: bigint>>"), ("n_words", "bigint"), ("collapsed", "string")]


def word_numbers(words: list[bytes], first: int) -> np.ndarray:
    """Equal words of one document get equal numbers, from `first` on."""
    table: dict[bytes, int] = {}
    known = table.setdefault
    return np.fromiter((known(w, len(table)) for w in words), np.int64, len(words)) + first


def proposals(place: np.ndarray, name: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, last place and distance of stretches of places whose factors of `size` words recur at one distance."""
    step, near = np.diff(place), name[1:] == name[:-1]
    near &= step <= 2 * size
    at, distance = place[:-1][near], step[near]
    order = np.argsort(at)
    at, distance = at[order], distance[order]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(distance) != 0)
    first = np.flatnonzero(new)
    last = np.append(first, len(at))[1:] - 1
    return at[first], at[last], distance[first]


def extended(words: np.ndarray, start: int, stop: int, period: int) -> tuple[int, int]:
    """The stretch from `start` to before `stop`, longer by the words that keep its period."""
    while start > 0 and words[start - 1] == words[start - 1 + period]:
        start -= 1
    while stop < len(words) and words[stop] == words[stop - period]:
        stop += 1
    return start, stop


def runs_of(words: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs in a sequence of word numbers, by start, then period.

    `longest` is the number of words of the longest document in it; documents share no number.
    """
    place, name, size = np.arange(len(words)), words, 1
    found: set[tuple[int, int, int]] = set()
    while len(place):
        order = np.argsort(name, kind="stable")
        place, name = place[order], name[order]
        first, last, distance = proposals(place, name, size)
        length = last - first + size + distance
        enough = length >= np.maximum(least, times * distance)
        for i, n, q in zip(first[enough].tolist(), length[enough].tolist(), distance[enough].tolist()):
            start, stop = extended(words, i, i + n, q)
            found.add((start, stop - start, q))
        # no run has a period above longest / times, and this level has seen those up to `size`
        if size * times >= longest:
            break
        again = np.zeros(len(place), bool)
        again[1:] = name[1:] == name[:-1]
        number = np.cumsum(~again)
        again[:-1] |= again[1:]
        names = np.zeros(len(words) + size, np.int64)
        names[place[again]] = number[again]
        place = np.sort(place[again])
        pair = names[place + size]
        place, pair = place[pair > 0], pair[pair > 0]
        name = names[place] * (len(words) + 1) + pair
        size *= 2
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when every run keeps its first period only; a word that any run drops goes."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ("doc_id",),
             rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """The columns `carry`, runs (by start, then period), n_words, and the collapsed text, its words joined by one blank.

    Words are what ASCII white space separates, in UTF-8. `rewrite` may change a document's words first; it gets its id.
    """
    held = list(dict.fromkeys(carry))
    kept, schema = replacing(docs.select(*held), _OUT)
    arrow, wide = output_schema(schema), len(kept.columns)
    ident = fresh(kept.columns, "ident")
    content = fresh([*kept.columns, ident], "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, wide + 1, SLICE_BYTES):
                yield worked(part)

    def worked(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.encode().split() if t else [] for t in part.column(wide + 1).to_pylist()]
        if rewrite is not None:
            texts = [rewrite(i, t) if t else t for i, t in zip(part.column(wide).to_pylist(), texts)]
        counts = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(counts)
        starts = ends - counts
        words = np.concatenate([word_numbers(t, first) for t, first in zip(texts, starts.tolist())])
        runs = runs_of(words, int(counts.max()))
        of = np.searchsorted(ends, runs[:, 0], "right")
        keep = kept_words(len(words), runs)
        joined = [b" ".join(t) for t in texts]
        for row in np.unique(of).tolist():
            joined[row] = b" ".join([w for w, k in zip(texts[row], keep[starts[row]:ends[row]].tolist()) if k])
        offsets = np.searchsorted(of, np.arange(len(texts) + 1))
        kind = arrow.field(wide).type
        fields = [pa.array(runs[:, 0] - starts[of]), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
        found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind.value_type)), type=kind)
        return pa.RecordBatch.from_arrays([*part.columns[:wide], found, pa.array(counts), pa.array(joined, pa.binary()).cast(pa.string())], schema=arrow)

    return docs.select(*kept.columns, F.col(id_col).cast("bigint").alias(ident), F.col(text_col).alias(content)).mapInArrow(run, schema)
