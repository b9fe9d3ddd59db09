"""Near-duplicate documents: SetSketch registers find candidates, full shingle sets confirm them.

1. One pass over the texts: a document's set of word shingles as 64-bit hashes, a digest of the set, and a SetSketch of it.
   A register is the truncated logarithm of the smallest of exponentially distributed values, one per shingle; sketches of
   parts merge by the maximum (`merged`).
2. Equal sets are one node from here on, however many documents share them.
3. Bands of registers are hashed. Nodes that share a band meet in a bucket; buckets with the same members count once. Inside
   a bucket the joint likelihood of two sketches estimates the similarity, and links whose estimate is within five standard
   errors of the limit or above it are kept as one star per connected part of the bucket, not as pairs.
4. Connected candidates form clusters. Only here shingle sets are made again, for members of clusters, and a cluster's links
   are confirmed on full sets by a search over an inverted list that visits every member once.
5. Components of confirmed links name the groups.

Hot groups: copies collapse in step 2. A bucket or cluster over the size of a task is cut into blocks, and each pair of
blocks is a group of its own, so that a task's memory and work are bounded; all pairs of blocks are covered, so no link is
lost. A task emits at most one link per member.

Recall: a link at the limit shares no band with a probability under 1e-6 (`MISS`), chosen through the number of registers
per band; the estimate loses one with about 3e-7.

Defined cases: empty and null texts have empty sets, which are linked with nothing; their group is their own id. Fewer words
than a shingle make one shingle of all words. Rows may repeat: equal texts are in one group whatever their ids. A row without
an id has the id of its group; a group without any id has none. Input columns are free, `deduplicated` returns all of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunloom.llm.common import forget, fresh, output_schema, run_folder, slices, staged
from sunloom.llm.components import components
from sunloom.llm.words import shingle_set

REGISTERS = 128
#: SetSketch's base, rate and highest register.
BASE, RATE, TOP = 1.001, 20.0, 65535
MISS = 1e-6
#: Nodes of a bucket that meet in one task, and nodes times shingles of a cluster.
BUCKET_NODES = 1_024
CLUSTER_WORK = 1_000_000_000
CLUSTER_SHINGLES = 4_000_000
#: Ids of documents whose sets are needed are broadcast up to this size, and joined by a shuffle beyond it.
BROADCAST_BYTES = 32 << 20

_draw = np.random.Generator(np.random.PCG64(20240229))
_SLOPE = _draw.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _draw.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set; all 0 for the empty set.

    Register i holds floor(1 - log_b x) of the smallest x, where x = -ln(1 - u) / rate and u is a uniform hash of a shingle.
    The map falls in x, so the smallest hash gives the largest value and only it is mapped.
    """
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint16)
    low = np.full(REGISTERS, 2**32 - 1, np.uint32)
    part = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(part), 2048):
        np.minimum(low, (part[at:at + 2048, None] * _SLOPE + _SHIFT).min(axis=0), out=low)
    x = -np.log1p(-(low + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, TOP).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


def similarity(a: np.ndarray, many: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities of sketch `a` of a set of n and sketches of sets of `sizes`.

    With u = n / (n + size) and v = 1 - u a register of the first set is larger with probability u - vJ, smaller with
    v - uJ and equal with J, up to terms in the base minus 1. The likelihood of the three counts is largest at the
    smaller root of a quadratic.
    """
    more, less = (a > many).sum(axis=1), (a < many).sum(axis=1)
    same = REGISTERS - more - less
    u = n / (n + sizes)
    v = 1 - u
    square, line = u * v * REGISTERS, same * (u * u + v * v) + more * v * v + less * u * u
    return (line - np.sqrt(np.maximum(line * line - 4 * square * same * u * v, 0))) / (2 * square)


def rows_per_band(limit: float) -> int:
    """The most registers a band can have so that a pair at `limit` is missed with MISS at most."""
    fits = [r for r in range(1, 17) if (1 - limit**r) ** (REGISTERS // r) <= MISS]
    return max(fits, default=1)


def sketches(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, hash of the text, n_shingles, digest of the set (null if empty) and registers."""
    schema = T._parse_datatype_string("id bigint, text_hash bigint, n_shingles bigint, digest binary, registers binary")
    arrow = output_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in slices(batch, 2):
                counts, digests, registers = [], [], []
                for text in part.column(2).to_pylist():
                    found = shingle_set(text, size)
                    counts.append(len(found))
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    registers.append(sketch(found).tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()),
                                                  pa.array(digests, pa.binary()), pa.array(registers, pa.binary())], schema=arrow)

    return docs.select(F.col(id_col).cast("bigint"), F.xxhash64(text_col), text_col).mapInArrow(run, schema)


def _grouped_rows(rows: DataFrame, keys: list[str], work: Callable) -> DataFrame:
    """Links (a, b) of the groups that share `keys`; `work` gets the table of a group and yields (digest, digest).

    Rows are dealt by the keys and sorted, so a group's rows follow each other and one group at a time is held. Rows have the
    keys first, then a digest; rows that repeat in these count once.
    """
    schema = T._parse_datatype_string("a binary, b binary")
    arrow, n_keys = output_schema(schema), len(keys)

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        found = list(work(pa.Table.from_batches(held).combine_chunks()))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*[batch.column(k).to_pylist() for k in range(n_keys + 1)]))
            first = 0
            for at, name in enumerate(names):
                if last is not None and name == last:  # a repeated row
                    if at > first:
                        held.append(batch.slice(first, at - first))
                    first = at + 1
                elif last is not None and name[:n_keys] != last[:n_keys]:
                    if at > first:
                        held.append(batch.slice(first, at - first))
                    if held:
                        yield links(held)
                    held, first = [], at
                last = name
            if first < len(names):
                held.append(batch.slice(first))
        if held:
            yield links(held)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "digest").mapInArrow(run, schema)


def _stars(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """Connected parts: (a member, the others). `near(i, rest)` says which of `rest` are linked with i; every member asks once."""
    rest, parts = np.arange(n), []
    while len(rest):
        root, rest = int(rest[0]), rest[1:]
        queue, part = [root], []
        while queue and len(rest):
            linked = near(queue.pop(), rest)
            if linked.any():
                new = rest[linked]
                part.append(new)
                queue.extend(new.tolist())
                rest = rest[~linked]
        if part:
            parts.append((root, np.concatenate(part)))
    return parts


def _blocks(rows: DataFrame, count: str) -> DataFrame:
    """Copies of rows for every pair (i, j) of `count` blocks that has the block of the row; one copy where there is one."""
    block = F.pmod(F.xxhash64("digest"), F.col(count))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))
    return rows.withColumn("_own", block).withColumn("_other", other).withColumns(
        {"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other")}).drop("_own", "_other")


def _bucket_links(percent: int, most_error: float):
    limit = percent / 100
    floor = limit - most_error * math.sqrt(limit * (1 - limit) / REGISTERS)

    def work(group: pa.Table):
        digest = group.column(3).to_pylist()
        if len(digest) < 2:
            return
        sizes = group.column(4).to_numpy()
        sketches_of = np.frombuffer(b"".join(group.column(5).to_pylist()), np.uint16).reshape(len(digest), REGISTERS)

        def near(i: int, rest: np.ndarray) -> np.ndarray:
            n = sizes[rest]
            fits = 100 * np.minimum(n, sizes[i]) >= percent * np.maximum(n, sizes[i])
            fits[fits] = similarity(sketches_of[i], sketches_of[rest[fits]], sizes[i], n[fits]) >= floor
            return fits

        for root, others in _stars(len(digest), near):
            yield from ((digest[root], digest[k]) for k in others.tolist())
    return work


def _cluster_links(percent: int):
    def work(group: pa.Table):
        digest = group.column(3).to_pylist()
        if len(digest) < 2:
            return
        sets = group.column(4).combine_chunks()
        offsets = sets.offsets.to_numpy()
        ids = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1]
        offsets = offsets - offsets[0]
        sizes = np.diff(offsets)
        of = np.repeat(np.arange(len(digest)), sizes)
        order = np.argsort(ids, kind="stable")
        holders, start = of[order], np.searchsorted(ids[order], np.arange(ids.max() + 2))

        def near(i: int, rest: np.ndarray) -> np.ndarray:
            own = ids[offsets[i]:offsets[i + 1]]
            lengths = start[own + 1] - start[own]
            at = np.repeat(start[own] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
            both = np.bincount(holders[at], minlength=len(digest))[rest]
            return 100 * both >= percent * (sizes[i] + sizes[rest] - both)

        for root, others in _stars(len(digest), near):
            yield from ((digest[root], digest[k]) for k in others.tolist())
    return work


def _sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(cluster, k, digest, shingles) of the rows that `wanted` (id, text_hash, cluster, k) names."""
    keyed = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)).alias("id"), F.xxhash64(text_col).alias("text_hash"),
                        F.col(text_col).alias("text"))
    wanted = wanted.withColumn("id", F.coalesce("id", F.lit(0)))
    small = wanted.count() * 64 <= BROADCAST_BYTES
    texts = keyed.join(F.broadcast(wanted) if small else wanted, ["id", "text_hash"]).select("cluster", "k", "text")
    schema = T._parse_datatype_string("cluster binary, k bigint, digest binary, shingles array<bigint>")
    arrow = output_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in slices(batch, 2):
                found = [shingle_set(t, size) for t in part.column(2).to_pylist()]
                offsets = np.append(0, np.cumsum([len(x) for x in found])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int64)))
                digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], digests, lists.cast(arrow.field(3).type)], schema=arrow)

    return texts.mapInArrow(run, schema)


def grouped(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, text_hash, n_shingles, component_id (smallest id of its group) and digest of the group."""
    folder = run_folder(docs.sparkSession, "near")
    own = staged(sketches(docs, size, id_col, text_col), folder, "sketches")
    nodes = staged(own.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("row"), F.min("n_shingles").alias("n_shingles"),
        F.min("registers").alias("registers")).select("digest", "row.id", "row.text_hash", "n_shingles", "registers"), folder, "nodes")
    rows = rows_per_band(percent / 100)
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("registers", 2 * rows * k + 1, 2 * rows)) for k in range(REGISTERS // rows)])
    banded = nodes.select(F.explode(keys).alias("key"), "digest")
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = staged(banded.join(shared, "key"), folder, "members")
    # buckets with the same members give the same links
    mark = members.groupBy("key").agg(F.first("n").alias("n"), F.bit_xor(F.xxhash64("digest")).alias("p"),
                                      F.bit_xor(F.xxhash64(F.lit(1), "digest")).alias("q"))
    once = mark.groupBy("n", "p", "q").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BUCKET_NODES).alias("k"))
    met = members.select("key", "digest").join(once, "key").join(nodes.select("digest", "n_shingles", "registers"), "digest")
    met = _blocks(met, "k").select("key", "i", "j", "digest", "n_shingles", "registers")
    likely = staged(_grouped_rows(met, ["key", "i", "j"], _bucket_links(percent, 5)).distinct(), folder, "likely")
    clusters = components(likely, f"{folder}/clusters").select(F.col("root").alias("cluster"), F.col("node").alias("digest"))
    inside = staged(clusters.join(nodes.drop("registers"), "digest"), folder, "inside")
    weight = inside.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    # a block has 1 / k of nodes and shingles, a pair of blocks twice that
    cut = F.greatest(F.sqrt(F.col("n") * F.col("total") / CLUSTER_WORK), F.col("total") / CLUSTER_SHINGLES)
    weight = weight.select("cluster", F.when(cut <= 1, 1).otherwise(F.ceil(2 * cut)).cast("bigint").alias("k"))
    wanted = inside.join(weight, "cluster").select("id", "text_hash", "cluster", "k")
    met = _blocks(_sets(docs, wanted, size, id_col, text_col), "k").select("cluster", "i", "j", "digest", "shingles")
    confirmed = staged(_grouped_rows(met, ["cluster", "i", "j"], _cluster_links(percent)), folder, "confirmed")
    groups = components(confirmed, f"{folder}/groups").toDF("digest", "root")
    named = staged(nodes.select("digest", "id").join(groups, "digest", "left").withColumn("root", F.coalesce("root", "digest")), folder, "named")
    of_digest = named.select("digest", "root").join(named.groupBy("root").agg(F.min("id").alias("component_id")), "root")
    return own.select("id", "text_hash", "n_shingles", "digest").join(of_digest, "digest", "left").select(
        "id", "text_hash", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("root").alias("component"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each group the one with the smallest id; all rows without words.

    Rows that repeat in id and text count as one, all of them stay or none.
    """
    folder = run_folder(docs.sparkSession, "near-kept")
    marks = staged(grouped(docs, size, percent, id_col, text_col).where("n_shingles > 0"), folder, "marks")
    first = marks.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("stays"))
    gone = marks.join(first, "component").where("NOT (id <=> stays.id AND text_hash = stays.text_hash)").select("id", "text_hash").distinct()
    gone = staged(gone, folder, "gone")
    small = gone.count() * 16 <= BROADCAST_BYTES
    names = fresh(docs.columns, "gone_id"), fresh(docs.columns, "gone_hash")
    gone = gone.toDF(*names)
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col(names[0])) & (F.xxhash64(text_col) == F.col(names[1]))
    return docs.join(F.broadcast(gone) if small else gone, same, "left_anti")
