"""Token ids on disk: frequency-ranked ids, byte-aligned lengths in separate control bytes, decoded by table lookup.

`encode` gives the ids of the public library for whole texts and keeps them in a table, with per-task counts of ids beside
them. Texts are cut before white space, where byte-level BPE never joins anything; each different chunk goes through the library
once, repetitions are array lookups (`chunk_ids`). Special strings inside texts are treated as the library does by default. `write`
ranks ids by frequency and writes files in ascending order of document id. `read` gives the documents back.

Layout of a data file: blocks one after the other. A block is, all little-endian:

    magic b"SVB1", documents (u32), ids (u64), data bytes (u64)
    document ids (i64 each), whether a document has an id (u8 each), ids per document (u64 each)
    control bytes: two bits per id, four ids to a byte from the low bits up: length of its rank in bytes, less one
    data bytes: ranks, little-endian, in as many bytes as the control bytes say
    one line feed

The folder `dictionary` holds the id of each rank (u32). Frequent ids have small ranks, so most take one byte.

Files are written by Spark's own writer with its commit protocol, so a lost executor leaves no half file; they are ordered by
the numbers in their names. Blocks have a bounded number of ids, files a bounded number of blocks.

Defined cases: null text is empty text, only the end id is written. Documents without an id come first; those that share an
id stand in no particular order among themselves. An empty table gives no data files, and `read` an empty table.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sunloom.llm.bpe import rank_file
from sunloom.llm.chunk_ids import ChunkIds, marks
from sunloom.llm.common import forget, once, output_schema, slices, staged
from sunloom.llm.token_counts import splits_at_space

#: Bytes of text that a task works on at once: more chunks share a lookup and a call.
SLICE_BYTES = 4 << 20
#: Chunks in one call of the library, and in a worker's table.
CALL, PLACES = 5_000, 1 << 20
BLOCK_IDS = 1 << 20
BLOCKS_PER_FILE = 32
#: Files whose first positions are broadcast; more are joined by a shuffle.
BROADCAST_FILES = 500_000

_HEAD = struct.Struct("<4sIQQ")
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
_ENCODED = "id bigint, n_tokens bigint, ids binary, counts boolean"


class Library:
    """New chunks to ids by the public library, special strings as it treats them by default."""

    def __init__(self, tokenizer: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_buffer(tokenizer)
        self.library.no_truncation()
        self.library.no_padding()

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out, ends = array("I"), []
        for at in range(0, len(chunks), CALL):
            for found in self.library.encode_batch_fast(chunks[at:at + CALL], add_special_tokens=False):
                out.extend(found.ids)
                ends.append(len(out))
        return np.frombuffer(out, "u4") if out else np.zeros(0, "u4"), np.diff(ends, prepend=0)


def whole_strings(tokenizer: bytes) -> list[str]:
    """Special strings of a tokenizer file, which no chunk may cut. An error where texts can't be cut at all."""
    about = json.loads(tokenizer)
    if not splits_at_space(about):
        raise ValueError("only byte-level tokenizers without normalizer can be cut at white space")
    return [t["content"] for t in about.get("added_tokens") or []]


def library_chunks(tokenizer: bytes, whole: list[str], dtype: str) -> ChunkIds:
    return ChunkIds(Library(tokenizer), dtype, marks(*whole), PLACES)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids with the end id behind them."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def vocabulary_size(tokenizer: bytes) -> int:
    from tokenizers import Tokenizer
    return Tokenizer.from_buffer(tokenizer).get_vocab_size()


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def encode(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table of ids per row, `end_id` last, zstd-compressed, and one row of counts by id for each task."""
    data = rank_file(tokenizer_path)
    key, size = ("library", hashlib.sha256(data).hexdigest()), vocabulary_size(data)
    dtype, special = id_type(size), whole_strings(data)
    sent = docs.sparkSession.sparkContext.broadcast(data)
    schema = T._parse_datatype_string(_ENCODED)
    arrow = output_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = once(key, lambda: library_chunks(sent.value, special, dtype))
        counts, squeeze = np.zeros(size, np.int64), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                ids, n = with_end(*chunks.encode(part.column(1)), end_id)
                counts += np.bincount(ids, minlength=size)
                whole, ends = memoryview(ids.view(np.uint8)), (np.cumsum(n) * ids.itemsize).tolist()
                small = [squeeze(whole[a:b]) for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(small, pa.binary()), pa.array([False] * len(n))], schema=arrow)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([counts.tobytes()], pa.binary()),
                                              pa.array([True])], schema=arrow)

    return staged(docs.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(run, schema), folder, "ids")


def frequency_order(encoded: DataFrame, size: int) -> np.ndarray:
    """All ids by falling count, ties by id. The counts that reach the driver are one number per id of the vocabulary."""
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                counts += np.frombuffer(x, np.int64)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["token", "n"])

    found = encoded.where("counts").select("ids").mapInArrow(total, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for row in found.toLocalIterator():
        counts[row.token] = row.n
    return np.lexsort((np.arange(size), -counts)).astype("<u4")


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks."""
    extra = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    for k in range(1, 4):
        extra[:len(ranks)] += ranks >= 1 << 8 * k
    control = extra.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    extra = extra[:len(ranks)]
    start = np.cumsum(extra, dtype=np.int64) - extra + np.arange(len(ranks))
    data = np.empty(len(ranks) + int(extra.sum()), np.uint8)
    data[start] = ranks.astype(np.uint8)
    for k in range(1, 4):
        more = np.flatnonzero(extra >= k)
        data[start[more] + k] = (ranks[more] >> np.uint32(8 * k)).astype(np.uint8)
    return (control[:, 0] | control[:, 1] | control[:, 2] | control[:, 3]).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Ranks from control and data bytes: lengths by table lookup, then one gather per byte place."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    start = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data, np.uint8)
    out = raw[start].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        out[more] |= raw[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block(ids: list[int | None], ranks: list[np.ndarray]) -> bytes:
    joined = np.concatenate(ranks)
    control, data = pack(joined)
    return b"".join([_HEAD.pack(b"SVB1", len(ids), len(joined), len(data)), np.array([i or 0 for i in ids], "<i8").tobytes(),
                     np.array([i is not None for i in ids], np.uint8).tobytes(), np.array([len(r) for r in ranks], "<u8").tobytes(), control, data])


def blocks(content: bytes) -> Iterator[tuple]:
    """(documents, ids, view of the rest) of every block of a file; the rest starts with the document ids."""
    at, view = 0, memoryview(content)
    while at < len(content):
        magic, docs, n, size = _HEAD.unpack_from(content, at)
        if magic != b"SVB1":
            raise ValueError("this is no token file")
        end = at + _HEAD.size + 17 * docs + -(-n // 4) + size
        yield docs, n, view[at + _HEAD.size:end]
        at = end + 1


def write(encoded: DataFrame, size: int, folder: str) -> None:
    """Files under `folder`/data, in ascending order of id over files and inside them, and `folder`/dictionary."""
    spark = encoded.sparkSession
    order = frequency_order(encoded, size)
    rank_of = np.empty(size, np.uint32)
    rank_of[order] = np.arange(size, dtype=np.uint32)
    sent, dtype = spark.sparkContext.broadcast(rank_of), id_type(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        ids, held, n, unpacked = [], [], 0, zstandard.ZstdDecompressor().decompress

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block(ids, held)], pa.binary())], names=["block"])

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ranks = sent.value[np.frombuffer(unpacked(x), dtype)]
                if held and n + len(ranks) > BLOCK_IDS:
                    yield done()
                    ids, held, n = [], [], 0
                ids.append(i)
                held.append(ranks)
                n += len(ranks)
        if held:
            yield done()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.where("NOT counts").select("id", "ids").repartitionByRange(parts, "id").sortWithinPartitions("id")
    # the text writer copies the bytes of a string as they are and ends each with the separator
    as_bytes = ordered.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value"))
    as_bytes.write.option("lineSep", "\n").option("maxRecordsPerFile", BLOCKS_PER_FILE).text(f"{folder}/data")
    table = spark.createDataFrame([(order.tobytes(),)], "content binary").coalesce(1)
    table.select(F.col("content").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{folder}/dictionary")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: doc_id, ids (binary: little-endian unsigned 32-bit), n_tokens and start, the number of ids before it."""
    name = r"part-(\d+)-.*?-c(\d+)"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/data").select(
        F.regexp_extract("path", name, 1).cast("bigint").alias("part"), F.regexp_extract("path", name, 2).cast("bigint").alias("piece"), "content")
    words = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/dictionary")
    order = np.frombuffer(bytes(words.first()["content"])[:-1], "<u4")
    sent = spark.sparkContext.broadcast(order)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            n = [sum(b[1] for b in blocks(x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64())], names=["part", "piece", "n"])

    schema = T._parse_datatype_string("part bigint, piece bigint, doc_id bigint, ids binary, n_tokens bigint, at bigint")
    arrow = output_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, piece, content in zip(*[c.to_pylist() for c in batch.columns]):
                before = 0
                for docs, n, rest in blocks(content):
                    ids = np.frombuffer(rest, "<i8", docs)
                    has = np.frombuffer(rest, np.uint8, docs, 8 * docs)
                    counts = np.frombuffer(rest, "<u8", docs, 9 * docs).astype(np.int64)
                    control = 17 * docs + -(-n // 4)
                    tokens = sent.value[unpack(rest[17 * docs:control], rest[control:], n)]
                    ends = np.cumsum(counts)
                    texts = [tokens[a:b].tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * docs, pa.int64()), pa.array([piece] * docs, pa.int64()), pa.array(ids, mask=has == 0),
                         pa.array(texts, pa.binary()), pa.array(counts), pa.array(before + ends - counts)], schema=arrow)
                    before += n

    # one row per file
    totals = files.mapInArrow(sizes, "part bigint, piece bigint, n bigint")
    earlier = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("part", "piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    few = len(files.inputFiles()) <= BROADCAST_FILES
    return files.mapInArrow(run, schema).join(F.broadcast(first) if few else first, ["part", "piece"]).select(
        "doc_id", "ids", "n_tokens", (F.col("first") + F.col("at")).alias("start"))
