"""Token ids of texts whose chunks repeat: each distinct chunk is encoded once, the rest are lookups in arrays.

A chunk is a run of white space and what follows it up to the next white space. No match of a split pattern for byte-level BPE
holds white space after something else, so ids of the chunks, one after the other, are the ids of the text. The usual pattern
(`SPLIT`) also ends a match where letters end: with it chunks end too before marks and digits that follow an ASCII letter, so
that a word has the same ids before a comma and before a blank.

All work per byte, chunk and token is done on arrays: chunks are found and hashed on the bytes of an Arrow column, equal
hashes are looked up once, and the ids of all places are gathered in one go. A worker keeps ids of chunks in a table of fixed
size (`Kept`), at the place that the hash says; a newer chunk takes the place of an older one. Two 64-bit hashes over
different random numbers stand for a chunk: both must agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from sunloom.llm.common import mixed

#: Places in a worker's table, a power of two, and ids that fit one place. Longer chunks are encoded whenever they come up.
PLACES, WIDE = 1 << 20, 10
#: Bytes of text that are hashed at once (a chunk that is longer is not cut).
SEGMENT = 1 << 19
#: Fixed value: the split pattern of most byte-level tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_draw = np.random.Generator(np.random.PCG64(19720105))
_BYTES = _draw.integers(1, 2**64, (2, 256), dtype=np.uint64)
_RADIX = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_powers: list[list[np.ndarray]] = [[np.ones(1, np.uint64)] * 2] * 2


def _power_tables(n: int) -> list[list[np.ndarray]]:
    """Per hash the powers of its radix and of the inverse modulo 2**64."""
    global _powers
    if len(_powers[0][0]) < n:
        size, _powers = max(n, SEGMENT + 1), []
        for radix in _RADIX:
            tables = []
            for base in (radix, pow(radix, -1, 1 << 64)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                tables.append(np.multiply.accumulate(steps))
            _powers.append(tables)
    return _powers


def gathered(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indexes start[0], start[0] + 1, ..., then those from start[1] on, as many as `length` says."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - length), length) + np.arange(total)


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values and the place where each starts, with the end of the last; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def binary_column(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Values that lie one after the other in `data`, ending at the bytes `ends`."""
    offsets = np.zeros(len(ends) + 1, np.int64)
    offsets[1:] = ends
    if offsets[-1] >= 1 << 31:
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def marks(*whole: str) -> np.ndarray:
    """Table of the ASCII bytes that are neither letters nor white space, but for those in strings that must stay whole."""
    table = ~_LETTER & ~_SPACE & (np.arange(256) < 128)
    table[[ord(c) for text in whole for c in text if ord(c) < 128]] = False
    return table


def chunk_starts(data: np.ndarray, texts: np.ndarray, after_letters: np.ndarray | None = None) -> np.ndarray:
    """Where chunks start: at texts, at ASCII white space after any character that is not white space, and, with the table
    `after_letters`, at its bytes after an ASCII letter."""
    space = _SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = space[1:] & ~space[:-1]
    # white space of several bytes before a blank belongs to the same run
    wide = np.flatnonzero(begins[:-1])
    wide = wide[data[wide - 1] >= 0x80]
    if len(wide):
        c, b, a = data[wide - 1], data[np.maximum(wide - 2, 0)], data[np.maximum(wide - 3, 0)]
        two = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
        high = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        other = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        begins[wide[two | high | other]] = False
    if after_letters is not None:
        begins[1:-1] |= _LETTER[data[:-1]] & after_letters[data[1:]]
    begins[texts] = True
    return np.flatnonzero(begins[:-1])


def chunk_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    out = []
    for table, (power, inverse) in zip(_BYTES, _power_tables(len(data) + 1)):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * power[:len(data)], out=sums[1:])
        out.append(mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)))
    return out


class Kept:
    """Ids of chunks by hash, in a table of fixed size."""

    def __init__(self, kind: str, places: int):
        self.first, self.second = np.zeros(places, np.uint64), np.zeros(places, np.uint64)
        self.count, self.ids = np.zeros(places, np.uint8), np.zeros((places, WIDE), kind)
        self.mask = np.uint64(places - 1)

    def place(self, first: np.ndarray) -> np.ndarray:
        return (first & self.mask).astype(np.int64)

    def put(self, first: np.ndarray, second: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        fits = np.flatnonzero((count > 0) & (count <= WIDE))
        # of chunks for one place the last stays
        _, last = np.unique(self.place(first[fits])[::-1], return_index=True)
        fits = fits[len(fits) - 1 - last]
        at, n = self.place(first[fits]), count[fits]
        starts = (np.cumsum(count) - count)[fits]
        self.first[at], self.second[at], self.count[at] = first[fits], second[fits], n
        self.ids[np.repeat(at, n), gathered(np.zeros_like(n), n)] = ids[gathered(starts, n)]


class ChunkIds:
    """Texts to ids. `fresh` encodes new chunks: all their ids one after the other, and the number of ids of each."""

    def __init__(self, fresh: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kind: str, after_letters: np.ndarray | None = None, places: int | None = None):
        self.fresh, self.kind, self.kept, self.after_letters = fresh, kind, Kept(kind, places or PLACES), after_letters

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each text."""
        data, at = raw_bytes(texts)
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(texts), np.int64)
        start = chunk_starts(data, at[:-1], self.after_letters)
        end = np.append(start[1:], len(data))
        first, second, low = [], [], 0
        while low < len(start):
            high = max(int(np.searchsorted(end, start[low] + SEGMENT, "right")), low + 1)
            base = start[low]
            for out, hashes in zip((first, second), chunk_hashes(data[base:end[high - 1]], start[low:high] - base, end[low:high] - base)):
                out.append(hashes)
            low = high
        pool, begin, count = self._known(data, start, end, np.concatenate(first), np.concatenate(second))
        total = np.zeros(len(start) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        ids, step = np.empty(int(total[-1]), self.kind), max(SEGMENT // 8, 1)
        for low in range(0, len(start), step):
            part = slice(low, low + step)
            ids[total[low]:total[min(low + step, len(start))]] = pool[gathered(begin[part], count[part])]
        return ids, np.diff(total[np.searchsorted(start, at)])

    def _known(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and for every chunk where its ids begin there and how many they are."""
        _, index, of = np.unique(first, return_index=True, return_inverse=True)
        if (second[index][of] != second).any():
            index = of = np.arange(len(first))
        first, second = first[index], second[index]
        place = self.kept.place(first)
        known = (self.kept.first[place] == first) & (self.kept.second[place] == second) & (self.kept.count[place] > 0)
        new = np.flatnonzero(~known)
        made, made_count = np.zeros(0, self.kind), np.zeros(0, np.int64)
        if len(new):
            view = memoryview(data)
            made, made_count = self.fresh([str(view[a:b], "utf-8") for a, b in zip(start[index[new]].tolist(), end[index[new]].tolist())])
        old = place[known]
        count = np.empty(len(index), np.int64)
        count[known], count[new] = self.kept.count[old], made_count
        old_count = count[known]
        pool = np.concatenate([self.kept.ids[np.repeat(old, old_count), gathered(np.zeros_like(old_count), old_count)], made.astype(self.kind, copy=False)])
        begin = np.empty(len(index), np.int64)
        begin[known] = np.cumsum(old_count) - old_count
        begin[new] = int(old_count.sum()) + np.cumsum(made_count) - made_count
        self.kept.put(first[new], second[new], made, made_count)
        return pool, begin[of], count[of]


class TokenBytes:
    """Ids to bytes by one gather."""

    def __init__(self, tokens: dict[int, bytes]):
        self.size = np.full(max(tokens, default=0) + 1, -1, np.int64)
        for i, token in tokens.items():
            self.size[i] = len(token)
        self.start = np.cumsum(np.maximum(self.size, 0)) - np.maximum(self.size, 0)
        self.data = np.frombuffer(b"".join(tokens[i] for i in sorted(tokens)), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """One binary value for each run of `counts` ids."""
        if len(ids) and (int(ids.max()) >= len(self.size) or (self.size[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        size = self.size[ids]
        out, done = np.empty(int(size.sum()), np.uint8), 0
        for at in range(0, len(ids), 1 << 18):
            part = slice(at, at + (1 << 18))
            found = self.data[gathered(self.start[ids[part]], size[part])]
            out[done:done + len(found)] = found
            done += len(found)
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        return binary_column(out, ends[np.cumsum(counts)])
