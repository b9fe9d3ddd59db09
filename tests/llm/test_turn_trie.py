"""Nodes against a dictionary of beginnings."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.llm import turn_trie
from sunloom.llm.queries import PLANS

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def conversations(rows):
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            held[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(role, text) for _, _, role, text in sorted(turns)] for c, turns in held.items()}


def expected(convs):
    """Rows of the nodes by plain dictionaries."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(node[-1][1].encode().split()) if node else 0
        leaves[node] = sum(leaves[b] for b in below[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[b] for b in below[node])
    return sorted(((min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(below[node]), leaves[node], saved[node],
                    hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, m in members.items()))


def found(nodes):
    assert nodes.columns == list(turn_trie.NODES)
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, *tuple(r)[3:]) for r in nodes.collect())


def test_tree_layouts():
    draw = np.random.Generator(np.random.PCG64(2))
    for n in (1, 4, 5, 16, 17, 48, 49, 256, 3000):
        keys = [draw.integers(0, 256, int(draw.integers(1, 4)) * 2, dtype=np.uint8).tobytes() for _ in range(n)] + [b"", b"\x00\x00"]
        keys += [bytes([i % 256, 7]) for i in range(n)]
        tree = turn_trie.Tree()
        for i, k in enumerate(keys):
            tree.add(k, i)
        got, todo = {}, [(tree.root, b"")]
        while todo:
            node, above = todo.pop()
            path, below = above + node.path, node.below()
            if node.ends:
                got[path] = node.ends
            assert node is tree.root or node.ends or len(below) > 1  # paths are compressed
            assert [b.path[0] for b in below] == sorted({b.path[0] for b in below}) or isinstance(node.branches, turn_trie.Indexed)
            places = {turn_trie.Few: 16, turn_trie.Indexed: 48, turn_trie.Full: 256}.get(type(node.branches), 0)
            assert places // 4 < len(below) <= places or isinstance(node.branches, turn_trie.Few) or not below
            todo.extend((b, path) for b in below)
        want = defaultdict(list)
        for i, k in enumerate(keys):
            want[k].append(i)
        assert got == want


def table():
    """A frequent first turn, equal conversations, one inside another, long ones, odd rows."""
    draw = np.random.Generator(np.random.PCG64(8))
    rows = []
    for c in range(400):
        n = int(draw.integers(1, 7))
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", "hello there" if t == 0 and c % 3 else f"w{draw.integers(0, 3)} " * int(draw.integers(0, 3)))
                 for t in range(n)]
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(150) for t in range(3)]
    rows += [(2000 + c, t, "user", f"long {t}" if t < 18 + c else f"own {c}") for c in range(12) for t in range(30)]
    rows += [(3000, None, "user", "no number"), (3000, 0, None, None), (3000, 1, "", ""), (3001, 5, "user", "x"), (3001, 5, "user", "x"),
             (None, 0, "user", "lost"), (3002, 0, "a", "bc"), (3003, 0, "ab", "c"), (-7, 0, "user", "hello there")]
    return rows


@pytest.mark.parametrize("parts", [1, 4, 40])
@pytest.mark.parametrize("keys", [16_384, 9, 1])
def test_nodes(spark, monkeypatch, parts, keys):
    monkeypatch.setattr(turn_trie, "SHARD_KEYS", keys)
    if keys == 9:
        monkeypatch.setattr(turn_trie, "BROADCAST_NODES", 0)
    rows = table()
    turns = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "words": F.lit(2), "path": F.lit(3)}).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = found(turn_trie.nodes(turn_trie.sequences(turns)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == expected(conversations(rows))


def test_no_turns_and_empty(spark):
    empty = spark.createDataFrame([], "conv_id bigint, key binary, words array<int>")
    assert turn_trie.nodes(empty).count() == 0
    assert turn_trie.sequences(spark.createDataFrame([], SCHEMA)).count() == 0
    bare = spark.createDataFrame([(5, bytearray(), []), (3, bytearray(), [])], empty.schema)
    assert found(turn_trie.nodes(bare)) == expected({5: [], 3: []})


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(PLANS["op12_turn_trie"](spark, small)) == expected(rebuilt(conversations(rows)))


def test_query_with_odd_rows(spark, tmp_path):
    rows = [r for r in table() if r[0] is None or r[0] >= 0 and r[0] not in (0, 40, 1000)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert found(PLANS["op12_turn_trie"](spark, str(tmp_path))) == expected(rebuilt(conversations(rows)))
