"""Byte-level BPE by a rank queue: buckets of linked-list positions per merge rank under a two-level bitmap.

`encode` adds the ids of a text, `decode` the bytes of ids, `round_trip` both. All are row-wise: no shuffle, partitions stay
as read. Texts are cut before white space, each different chunk goes through the rank queue, places that repeat it are array
lookups (`chunk_ids`). Ids become bytes by one gather over a table of tokens.

Merging: the bytes of all new pre-tokens of a batch form one linked list, with gaps between pre-tokens. Every neighbouring
pair that is a known token sits in the bucket of its rank; a bitmap over buckets, itself summed up by a second bitmap, gives
the lowest rank in two find-first-set steps whatever the length of the list. All places of a bucket are merged at once: tokens
are relinked and the new pairs entered; entries that a merge has made stale are skipped when they come up. Work is near-linear
in the length, so a pre-token of a megabyte is no issue, and many short ones cost no more than one long one.

Defined cases: null text encodes like empty text, to no ids (empty binary, n_tokens 0). Null or empty ids decode to empty
bytes. Rows, their order inside a partition and every input column are kept, repeated rows included; an input column
named like an output gives way to it. Ids outside the vocabulary are an error in `decode`.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sunloom.llm.chunk_ids import SPLIT, ChunkIds, TokenBytes, binary_column, marks, raw_bytes
from sunloom.llm.common import once, output_schema, replacing, slices, with_arrays

#: Pieces (matches of the split pattern) whose ids a worker keeps, and the characters of the longest of them.
KEPT_PIECES, PIECE_CHARS = 20_000, 64

#: Bytes of text that a task works on at once; its arrays take about 30 times as much.
SLICE_BYTES = 1 << 20

_BITS = 256
#: Fixed value: the characters of Unicode's White_Space.
_SPACE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Code points that are letters or numbers only since Unicode 17. The matched library follows Unicode 16,
#: where they are neither; they are split as the private-use character U+E000 is.
_LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F))
_NEW = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _LATER) + "]")


class RankQueue:
    """Places by rank: a bucket per rank, a bitmap of the buckets in use, and a bitmap of that bitmap's words."""

    __slots__ = ("top", "words", "buckets")

    def __init__(self):
        self.top, self.words, self.buckets = 0, {}, {}

    def push(self, rank: int, places: np.ndarray) -> None:
        if rank in self.buckets:
            self.buckets[rank].append(places)
            return
        self.buckets[rank] = [places]
        high = rank // _BITS
        self.words[high] = self.words.get(high, 0) | 1 << rank % _BITS
        self.top |= 1 << high

    def push_all(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Each place into the bucket of its rank."""
        if len(ranks) == 1:
            self.push(int(ranks[0]), places)
            return
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for rank, a, b in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)]):
            self.push(rank, places[a:b])

    def pop(self) -> tuple[int, np.ndarray]:
        """The lowest rank and all that was put into its bucket, stale places too."""
        top = self.top
        high = (top & -top).bit_length() - 1
        word = self.words[high]
        low = word & -word
        rank = high * _BITS + low.bit_length() - 1
        if word == low:
            del self.words[high]
            self.top = top & (top - 1)
        else:
            self.words[high] = word ^ low
        held = self.buckets.pop(rank)
        return rank, held[0] if len(held) == 1 else np.concatenate(held)


class Pairs:
    """Ranks of pairs of tokens, for every way that a token falls into two others."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values(), default=0) + 1
        found = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    found[a * self.size + b] = rank
        self.keys = np.array(sorted(found) or [-1], np.int64)
        self.ranks = np.array([found.get(k, -1) for k in self.keys.tolist()], np.int64)
        self.bytes = np.array([ranks.get(bytes([x]), -1) for x in range(256)], np.int64)
        self.first = np.array([[ranks.get(bytes([x, y]), -1) for y in range(256)] for x in range(256)], np.int64)

    def __call__(self, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


class Places:
    """Pre-tokens as one linked list of tokens with a gap after each pre-token, merged by one rank queue.

    Pre-tokens don't touch, so each is merged as if it were alone: its lowest rank first, of equal ones the leftmost. All places of
    a rank are merged in one go, but in a pre-token not beyond a merge that makes a pair of a lower rank; the places behind it
    go back into the bucket.
    """

    def __init__(self, pieces: list[bytes], pairs: Pairs):
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array([len(p) for p in pieces], np.int64)
        last = np.cumsum(size) - 1
        n = len(data)
        self.pairs, self.count = pairs, len(pieces)
        self.of = np.repeat(np.arange(len(pieces)), size)
        self.token = pairs.bytes[data]
        self.after, self.before = np.arange(1, n + 1), np.arange(-1, n - 1)
        self.after[last], self.before[last - size + 1] = -1, -1
        self.alive = np.ones(n, bool)
        # the rank of a token joined with the next one
        self.pair = np.full(n, -1)
        self.pair[:-1] = pairs.first[data[:-1], data[1:]]
        self.pair[last] = -1

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each pre-token."""
        queue, start = RankQueue(), np.flatnonzero(self.pair >= 0)
        if len(start):
            queue.push_all(self.pair[start], start)
        while queue.top:
            rank, held = queue.pop()
            held = held[self.pair[held] == rank]
            if not len(held):
                continue
            at, back = (held, None) if len(held) == 1 else self.allowed(rank, np.unique(held))
            self.join(rank, at, queue)
            if back is not None:
                back = back[self.pair[back] == rank]
                if len(back):
                    queue.push(rank, back)
        heads = np.flatnonzero(self.alive)
        return self.token[heads], np.bincount(self.of[heads], minlength=self.count)

    def allowed(self, rank: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Of the sorted places of a rank those that may be merged at once, and the others."""
        of, at = self.of[places], places
        if not (of[1:] == of[:-1]).any():
            return at, None
        linked = self.after[places[:-1]] == places[1:]
        if linked.any():
            # of places that share a token every other one, from the left
            number = np.arange(len(places))
            begin = np.maximum.accumulate(np.where(np.append(False, linked), 0, number))
            at = places[(number - begin) % 2 == 0]
        gone, of = self.after[at], self.of[at]
        right, left = self.after[gone], self.before[at]
        # a merge from left to right meets its left neighbour merged and its right neighbour as it is
        joined = np.append(False, left[1:] == gone[:-1])
        on_left = np.where(left >= 0, self.pairs(np.where(joined, rank, self.token[left]), rank), -1)
        on_right = np.where(right >= 0, self.pairs(rank, self.token[right]), -1)
        lower = (on_left >= 0) & (on_left < rank) | (on_right >= 0) & (on_right < rank)
        before = np.cumsum(lower) - lower
        first = np.append(True, of[1:] != of[:-1])
        stay = before == np.maximum.accumulate(np.where(first, before, 0))
        return at[stay], places

    def join(self, rank: int, at: np.ndarray, queue: RankQueue) -> None:
        gone = self.after[at]
        end = self.after[gone]
        self.token[at], self.after[at] = rank, end
        inner = end >= 0
        self.before[end[inner]] = at[inner]
        self.pair[gone], self.alive[gone] = -1, False
        left = self.before[at]
        left = left[left >= 0]
        touched = np.concatenate([at, left])
        follows = self.after[touched]
        has = np.flatnonzero(follows >= 0)
        new = np.full(len(touched), -1)
        new[has] = self.pairs(self.token[touched[has]], self.token[follows[has]])
        self.pair[touched] = new
        found = np.flatnonzero(new >= 0)
        if len(found):
            queue.push_all(new[found], touched[found])


def merge_all(pieces: list[bytes], pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pre-tokens, one after the other, and the number of ids of each."""
    if not any(pieces):
        return np.zeros(0, np.int64), np.zeros(len(pieces), np.int64)
    return Places(pieces, pairs).merged()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: per line a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Merger:
    """New chunks to ids: cut by the split pattern, new pieces merged together; ids of pieces are kept up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.kept: dict[str, list[int]] = {}
        self.ranks, self.pairs, self.split = ranks, Pairs(ranks), regex.compile(pattern).findall

    def pieces(self, chunk: str) -> list[str]:
        if chunk.isascii() or not _NEW.search(chunk):
            return self.split(chunk)
        ends = np.cumsum([len(x) for x in self.split(_NEW.sub("\ue000", chunk))]).tolist()
        return [chunk[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, texts: list[str]) -> dict[str, list[int]]:
        """Ids of pieces that are not kept. A piece that is a token as a whole needs no merging."""
        found, rest = {}, []
        for text in texts:
            known = self.ranks.get(text.encode())
            if known is None:
                rest.append(text)
            else:
                found[text] = [known]
        ids, counts = merge_all([t.encode() for t in rest], self.pairs)
        ids, ends = ids.tolist(), np.cumsum(counts).tolist()
        found.update((t, ids[a:b]) for t, a, b in zip(rest, [0, *ends], ends))
        return found

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [self.pieces(c) for c in chunks]
        new = self.learn([p for p in {p for c in cut for p in c} if p not in self.kept])
        out, ends = array("I"), []
        for chunk in cut:
            for piece in chunk:
                out.extend(new[piece] if piece in new else self.kept[piece])
            ends.append(len(out))
        if len(self.kept) + len(new) > KEPT_PIECES:
            self.kept.clear()
        self.kept.update((p, ids) for p, ids in islice(new.items(), KEPT_PIECES) if len(p) <= PIECE_CHARS)
        return np.frombuffer(out, "u4") if out else np.zeros(0, "u4"), np.diff(ends, prepend=0)


def coder(ranks: dict[bytes, int], pattern: str) -> ChunkIds:
    kind = "<u2" if max(ranks.values(), default=0) < 1 << 16 else "<u4"
    return ChunkIds(Merger(ranks, pattern), kind, marks() if pattern == SPLIT else None)


def rank_file(path: str, most: int = 64 << 20) -> bytes:
    """A vocabulary file, read on the driver; it is sent to the tasks, so its size is checked."""
    with open(path, "rb") as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ValueError(f"{path} is larger than {most} bytes")
    return data


def _named(path: str, *more: str) -> tuple[bytes, tuple]:
    data = rank_file(path)
    return data, (hashlib.sha256(data).hexdigest(), *more)


def _ids(coded: tuple[np.ndarray, np.ndarray]) -> list[pa.Array]:
    ids, counts = coded
    return [binary_column(ids.astype("<u4").view(np.uint8), np.cumsum(counts) * 4), pa.array(counts, pa.int64())]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", count: str = "n_tokens") -> DataFrame:
    """`docs` with `ids` (binary: little-endian unsigned 32-bit) and `count` of them, whole texts, no special tokens."""
    data, name = _named(ranks_path, pattern)
    sent = docs.sparkSession.sparkContext.broadcast(data)
    docs, schema = replacing(docs, [(ids, "binary"), (count, "bigint")], text)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = once(("encode", *name), lambda: coder(parse_ranks(sent.value), pattern))
        for batch in batches:
            for part in slices(batch, at, SLICE_BYTES):
                yield with_arrays(part, output_schema(schema), _ids(chunks.encode(part.column(at))))

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`rows` with the bytes that `ids` stand for."""
    data, name = _named(ranks_path)
    sent = rows.sparkSession.sparkContext.broadcast(data)
    rows, schema = replacing(rows, [(out, "binary")], ids)
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = once(("decode", *name), lambda: TokenBytes({i: t for t, i in parse_ranks(sent.value).items()}))
        for batch in batches:
            for part in slices(batch, at, SLICE_BYTES):
                held, ends = raw_bytes(part.column(at))
                yield with_arrays(part, output_schema(schema), [tokens.decode(held.view("<u4"), np.diff(ends) // 4)])

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", count: str = "n_tokens",
               out: str = "decoded") -> DataFrame:
    """`docs` with the columns of `encode` and, from the ids, that of `decode`: both in one visit to the workers."""
    data, name = _named(ranks_path, pattern)
    sent = docs.sparkSession.sparkContext.broadcast(data)
    docs, schema = replacing(docs, [(ids, "binary"), (count, "bigint"), (out, "binary")], text)
    at = docs.columns.index(text)

    def make() -> tuple[ChunkIds, TokenBytes]:
        ranks = parse_ranks(sent.value)
        return coder(ranks, pattern), TokenBytes({i: t for t, i in ranks.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, tokens = once(("round trip", *name), make)
        for batch in batches:
            for part in slices(batch, at, SLICE_BYTES):
                coded = _ids(chunks.encode(part.column(at)))
                held, ends = raw_bytes(coded[0])
                yield with_arrays(part, output_schema(schema), [*coded, tokens.decode(held.view("<u4"), np.diff(ends) // 4)])

    return docs.mapInArrow(run, schema)
