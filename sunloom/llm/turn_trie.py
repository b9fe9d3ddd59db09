"""The trie of all conversation beginnings, built as adaptive radix trees over turn ids.

A turn's id is the first 16 bytes of the SHA-256 of its role and text, read as a big-endian number, so ids have a fixed width
and the bytes of a sequence of ids sort like the sequence. `sequences` makes one row per conversation of a table of turns,
`nodes` one row per distinct beginning of d turns.

* Sequences are range-partitioned and sorted by their bytes, so conversations with a common beginning are neighbours. The
  conversation id breaks ties: equal conversations, and those below one frequent first turn, fill as many partitions as they
  need. Splitters are sampled from the first `HEAD` bytes.
* Each partition is cut into shards of at most `SHARD_KEYS` conversations. A shard's conversations go into one adaptive radix
  tree (`Tree`): inner nodes grow from 4 over 16 and 48 to 256 places, bytes without a branch are compressed into the node
  below. Only depths that are whole turns give nodes of the trie.
* A beginning can lie in several shards only if it is one of a shard's first or last conversation (or goes on from their
  first `HEAD` bytes). Such nodes, about two per shard and turn, leave the shard as partial sums without the others' shares;
  aggregations add them up, and each gives its own share to all its ancestors. All other nodes are final in their shard.
* The ids of conversations that end at a node stay in their shard and are hashed there; of a node in several shards the
  pieces, in order, stream through one hash, so a conversation repeated any number of times needs no memory.

A conversation is one row of 20 bytes per turn, without texts; this bounds the length of one conversation, not of the table.

Defined cases: null role or text is empty. Turns are ordered by number, missing numbers first, equal numbers by turn id.
Rows without a conversation id are left out. Repeated rows are further turns. An empty table gives an empty table; a
conversation without turns is a member of the root. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunloom.llm.common import output_schema, run_folder, staged

WIDTH = 16
#: Bytes of a sequence that the splitters of the range partitions see.
HEAD = 16 * WIDTH
#: Conversations, and bytes of their sequences, in one tree.
SHARD_KEYS, SHARD_BYTES = 16_384, 8 << 20
#: Nodes that lie in several shards are sent to all executors up to this number, and joined by a shuffle beyond.
BROADCAST_NODES = 200_000
NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
#: The words of a text.
WORDS = r"[^\x20\x09-\x0D]+"

# ------------------------------------------------------------------------------------------------- adaptive radix tree


class Few:
    """Up to 16 branches: sorted bytes beside their nodes. Starts with 4 places."""

    __slots__ = ("places", "bytes", "nodes")

    def __init__(self):
        self.places, self.bytes, self.nodes = 4, bytearray(), []

    def get(self, byte: int):
        i = self.bytes.find(byte)
        return self.nodes[i] if i >= 0 else None

    def put(self, byte: int, node) -> "Few | Indexed":
        i = bisect_left(self.bytes, byte)
        if i < len(self.bytes) and self.bytes[i] == byte:
            self.nodes[i] = node
            return self
        if len(self.bytes) == self.places:
            if self.places == 16:
                return Indexed(self).put(byte, node)
            self.places = 16
        self.bytes.insert(i, byte)
        self.nodes.insert(i, node)
        return self

    def all(self) -> list:
        return self.nodes


class Indexed:
    """Up to 48 branches: a table of 256 places names the slot of each byte."""

    __slots__ = ("slot", "nodes")

    def __init__(self, few: Few):
        self.slot, self.nodes = bytearray(256), list(few.nodes)
        for i, byte in enumerate(few.bytes, 1):
            self.slot[byte] = i

    def get(self, byte: int):
        i = self.slot[byte]
        return self.nodes[i - 1] if i else None

    def put(self, byte: int, node) -> "Indexed | Full":
        i = self.slot[byte]
        if i:
            self.nodes[i - 1] = node
            return self
        if len(self.nodes) == 48:
            return Full(self).put(byte, node)
        self.nodes.append(node)
        self.slot[byte] = len(self.nodes)
        return self

    def all(self) -> list:
        return [self.nodes[i - 1] for i in self.slot if i]


class Full:
    """A node for every byte."""

    __slots__ = ("nodes",)

    def __init__(self, indexed: Indexed):
        self.nodes = [indexed.get(byte) for byte in range(256)]

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> "Full":
        self.nodes[byte] = node
        return self

    def all(self) -> list:
        return [n for n in self.nodes if n is not None]


class Node:
    """`path`: the bytes from the branch above down to here; `ends`: numbers of the sequences that end here."""

    __slots__ = ("path", "branches", "ends")

    def __init__(self, path: bytes):
        self.path, self.branches, self.ends = path, None, []

    def put(self, node: "Node") -> None:
        self.branches = (Few() if self.branches is None else self.branches).put(node.path[0], node)

    def below(self) -> list:
        return [] if self.branches is None else self.branches.all()


def common(a: bytes, b: bytes) -> int:
    """Number of leading bytes that are equal."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class Tree:
    def __init__(self):
        self.root = Node(b"")

    def add(self, key: bytes, number: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = None if node.branches is None else node.branches.get(key[at])
            if child is None:
                leaf = Node(key[at:])
                leaf.ends.append(number)
                node.put(leaf)
                return
            same = common(child.path, key[at:at + len(child.path)])
            if same < len(child.path):
                # the path parts here: a new node takes the common bytes, the old one keeps the rest
                middle = Node(child.path[:same])
                child.path = child.path[same:]
                middle.put(child)
                node.put(middle)
                child = middle
            node, at = child, at + same
        node.ends.append(number)


# ----------------------------------------------------------------------------------------------------------- one shard
class Sums:
    """What a subtree hands up: members, the smallest of them, an example, shares of final nodes, and its topmost nodes."""

    __slots__ = ("n", "least", "example", "leaves", "saved", "tops")

    def __init__(self):
        self.n, self.least, self.example, self.leaves, self.saved, self.tops = 0, None, None, 0, 0, []

    def add(self, other: "Sums") -> None:
        self.n += other.n
        self.least = other.least if self.least is None else min(self.least, other.least)
        self.example = other.example
        self.leaves += other.leaves
        self.saved += other.saved
        self.tops += other.tops


class Shard:
    """Trie nodes of a run of sorted sequences. Rows: the columns of `_PARTS`."""

    def __init__(self, keys: list[bytes], convs: list[int], words: list[list[int]], part: int, number: int):
        self.keys, self.convs, self.words, self.part, self.number = keys, convs, words, part, number
        self.borders = (keys[0], keys[-1])
        self.heads = {k[:HEAD] for k in self.borders if len(k) >= HEAD}
        self.rows: list[list] = []
        self.known: dict[bytes, list[bytes]] = {}

    def open(self, example: int, length: int) -> bool:
        """Whether other shards may hold members of the beginning of `length` bytes of sequence `example`."""
        start = self.keys[example][:length]
        return any(k.startswith(start) for k in self.borders) or length > HEAD and start[:HEAD] in self.heads

    def ids(self, start: bytes) -> list[bytes]:
        """Names of a beginning and of all those before it, from the root on."""
        found = self.known.get(start)
        if found is None:
            above = self.ids_above(start)
            name = hashlib.blake2b(above[-1] + start[-WIDTH:] if above else b"", digest_size=16).digest()
            found = self.known[start] = [*above, name]
        return found

    def ids_above(self, start: bytes) -> list[bytes]:
        """Without recursion, as conversations can be long."""
        at = len(start) - WIDTH
        while at >= 0 and start[:at] not in self.known:
            at -= WIDTH
        for length in range(max(at, -WIDTH) + WIDTH, len(start), WIDTH):
            above = self.known.get(start[:length - WIDTH], []) if length else []
            tail = above[-1] + start[length - WIDTH:length] if length else b""
            self.known[start[:length]] = [*above, hashlib.blake2b(tail, digest_size=16).digest()]
        return self.known[start[:-WIDTH]] if start else []

    def emit(self, sums: Sums, depth: int, ends: list[int]) -> None:
        """The node `depth` turns down; `sums` holds what lies below it, and then the node too."""
        convs = ",".join([str(self.convs[i]) for i in ends])
        row_at, spent = len(self.rows), self.words[sums.example][depth - 1] if depth else 0
        children = [r for r in sums.tops if self.rows[r][-1] is None]
        if self.open(sums.example, depth * WIDTH):
            path = self.ids(self.keys[sums.example][:depth * WIDTH])
            # the parent of the final nodes below is known by name only
            for r in children:
                self.rows[r][2] = path[-1]
            self.rows.append([sums.least, depth, path[-2] if depth else None, None, sums.n, len(children), sums.leaves, sums.saved, None,
                              spent, self.part, self.number, convs.encode() if ends else None, path])
        else:
            if not sums.tops:
                sums.leaves = 1
            sums.saved += (sums.n - 1) * spent
            for r in sums.tops:
                self.rows[r][3] = sums.least
            self.rows.append([sums.least, depth, None, None, sums.n, len(sums.tops), sums.leaves, sums.saved,
                              hashlib.sha256(convs.encode()).hexdigest(), None, None, None, None, None])
        sums.tops = [row_at]

    def build(self) -> list[list]:
        tree = Tree()
        for i, key in enumerate(self.keys):
            tree.add(key, i)
        done: list[Sums] = []
        # nodes are met before and after those below; `start` is the byte depth above the path of a node
        todo: list[tuple[Node, int, bool]] = [(tree.root, 0, False)]
        while todo:
            node, start, after = todo.pop()
            below = node.below()
            if not after:
                todo.append((node, start, True))
                todo.extend((child, start + len(node.path), False) for child in below)
                continue
            sums, end = Sums(), start + len(node.path)
            for child in done[len(done) - len(below):]:
                sums.add(child)
            del done[len(done) - len(below):]
            if node.ends:
                sums.n += len(node.ends)
                sums.example = node.ends[0]
                least = self.convs[node.ends[0]]
                sums.least = least if sums.least is None else min(sums.least, least)
            for length in range(end - end % WIDTH, start, -WIDTH):
                self.emit(sums, length // WIDTH, node.ends if length == end else [])
            if node is tree.root:
                self.emit(sums, 0, node.ends)
            done.append(sums)
        return self.rows


_PARTS = ("conv_id bigint, depth bigint, parent binary, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
          "saved_tokens bigint, ends_sha256 string, words bigint, part int, shard bigint, ends binary, path array<binary>")


def _shards(schema: pa.Schema):
    """Rows of `_PARTS` from sorted partitions of (key, conv_id, words, part)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, convs, words, size, number, part = [], [], [], 0, 0, 0

        def built() -> Iterator[pa.RecordBatch]:
            rows = Shard(keys, convs, words, part, number).build()
            for at in range(0, len(rows), 10_000):
                columns = zip(*rows[at:at + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for key, conv, count, part_of in zip(*[c.to_pylist() for c in batch.columns]):
                if keys and (len(keys) >= SHARD_KEYS or size + len(key) > SHARD_BYTES):
                    yield from built()
                    keys, convs, words, size, number = [], [], [], 0, number + 1
                keys.append(key)
                convs.append(conv)
                words.append(count)
                size += len(key)
                part = part_of
        if keys:
            yield from built()
    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from its pieces in order, comma-joined; a node's pieces are neighbours."""
    node, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])

    for batch in batches:
        for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name == node:
                digest.update(b",")
            else:
                if node is not None:
                    yield done()
                node, digest = name, hashlib.sha256()
            digest.update(piece)
    if node is not None:
        yield done()


# ---------------------------------------------------------------------------------------------------------- operators
def turn_id(role: Column, text: Column) -> Column:
    """The id of a turn as 32 hexadecimal digits; the length of the role keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, key (its turn ids in order, as bytes) and words (words of each turn's text)."""
    turn = F.struct(F.col(turn_col).cast("bigint").alias("at"), turn_id(F.col(role_col), F.col(text_col)).alias("id"),
                    F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS)).alias("words"))
    held = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("bigint").alias("conv_id"), turn.alias("turn"))
    ordered = held.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return ordered.select("conv_id", F.unhex(F.array_join("turns.id", "")).alias("key"), F.col("turns.words").alias("words"))


def continued(sequences: DataFrame, source: Column, shared: Column) -> DataFrame:
    """Every sequence with its first `shared` turns replaced by the first `shared` turns of conversation `source`.

    Fewer are taken where that conversation has fewer, none where it is absent. Both are columns over conv_id; `shared` is
    at most the number of turns that the caller wants to cross the join, as only such beginnings are joined.
    """
    own = sequences.withColumns({"_source": source, "_shared": shared.cast("int")})
    wanted = own.select("_source", "_shared").groupBy(F.col("_source").alias("conv_id")).agg(F.max("_shared").alias("_most"))
    starts = sequences.join(wanted, "conv_id").select(
        F.col("conv_id").alias("_source"), F.col("key").substr(F.lit(1), F.col("_most") * WIDTH).alias("_key"),
        F.slice("words", F.lit(1), F.col("_most")).alias("_words"))
    taken = F.coalesce(F.col("_key").substr(F.lit(1), F.col("_shared") * WIDTH), F.lit(b""))
    rest = F.col("key").substr(F.col("_shared") * WIDTH + 1, F.length("key"))
    words = F.concat(F.coalesce(F.slice("_words", F.lit(1), F.col("_shared")), F.array().cast("array<int>")),
                     F.slice("words", F.col("_shared") + 1, F.size("words")))
    return own.join(starts, "_source", "left").select("conv_id", F.concat(taken, rest).alias("key"), words.alias("words"))


def nodes(sequences: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per distinct beginning of the sequences (conv_id, key, words), see `NODES`.

    conv_id is the smallest member, parent_conv_id that of the beginning one turn shorter (null for the root), n_convs counts
    members, n_children the beginnings one turn longer, n_leaves the childless ones at or below, saved_tokens adds up
    (members - 1) * words of the last turn at or below, ends_sha256 is of the ascending ids of members with no further turn.
    """
    spark = sequences.sparkSession
    folder = folder or run_folder(spark, "trie")
    # the end of the conversations sorts by bytes; ids are cut over partitions only among equal heads
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sequences.select("key", "conv_id", "words").repartitionByRange(ranges, F.substring("key", 1, HEAD), "conv_id")
    dealt = dealt.sortWithinPartitions("key", "conv_id").withColumn("part", F.spark_partition_id())
    schema = T._parse_datatype_string(_PARTS)
    parts = staged(dealt.mapInArrow(_shards(output_schema(schema)), schema), folder, "parts")
    final, partial = parts.where("path IS NULL"), parts.where("path IS NOT NULL").withColumn("node", F.element_at("path", -1))

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = partial.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"),
                                         F.first("words").alias("words"), F.first("path").alias("path"), *sums)
    merged = staged(merged, folder, "merged")
    inner = merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_inner"))
    merged = merged.join(inner, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("n_inner", F.lit(0)))
    given = merged.select(F.explode("path").alias("node"), (F.col("n_children") == 0).cast("bigint").alias("leaf"),
                          ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    given = given.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    ends = partial.where("ends IS NOT NULL").select("node", "ends", "part", "shard").repartition("node").sortWithinPartitions("node", "part", "shard")
    ends = ends.select("node", "ends").mapInArrow(_hashed, "node binary, ends_sha256 string")
    none = hashlib.sha256(b"").hexdigest()
    shared = merged.join(given, "node").join(ends, "node", "left").select(
        "node", "conv_id", "depth", "parent", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("own")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    shared = staged(shared, folder, "shared")

    above = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))
    if shared.count() <= BROADCAST_NODES:
        above = F.broadcast(above)
    inside = final.where("parent IS NULL")
    hung = final.where("parent IS NOT NULL").unionByName(shared, allowMissingColumns=True).join(above, "parent", "left")
    return inside.select(*NODES).unionByName(hung.withColumn("parent_conv_id", F.col("_above")).select(*NODES))
