"""Sketches, clusters and groups against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.llm import near
from sunloom.llm import words as hashed
from sunloom.llm.components import components
from sunloom.llm.queries import PLANS

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE:
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingles(text, size):
    w = words(text)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size, percent):
    """Component of every row by comparing all pairs over an inverted list."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    parent[top(i)] = top(j)
    group = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            group[top(k)] = min(group.get(top(k), i), i)
    return [(i, len(sets[k]), (group.get(top(k)) if sets[k] else i)) for k, (i, _) in enumerate(rows)]


def corpus(seed=1):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    rows, at = [], 0
    common = text(60)
    for base_size, copies, edits in ((120, 60, 0.03), (200, 40, 0.02), (40, 50, 0.04), (400, 20, 0.01), (15, 20, 0.1)):
        base = text(base_size)
        for _ in range(copies):
            copy = [draw.choice(vocabulary) if draw.random() < edits * draw.random() * 2 else w for w in base]
            rows.append((at * 7 % 1009, " ".join(copy)))
            at += 1
    rows += [(2000 + i, " ".join(common + text(draw.randrange(1, 80)))) for i in range(40)]
    rows += [(3000 + i, " ".join(text(draw.randrange(1, 50)))) for i in range(40)]
    rows += [(4000, None), (4001, ""), (4002, " \n"), (4003, "one"), (4004, "ONE"), (4005, "one two"), (None, "one two"),
             (4006, "Só\u00a0x y É"), (4007, "só\u00a0x Y É"), (4003, "one"), (None, "alone without an id")]
    rows += [(5000 + i, rows[0][1].upper()) for i in range(30)]
    return rows


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_matches_all_pairs(spark, size, percent):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, n_shingles string")
    got = near.grouped(docs, size, percent)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got.collect()), key=key) == sorted(brute(rows, size, percent), key=key)


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(near, "BUCKET_NODES", 5)
    monkeypatch.setattr(near, "CLUSTER_WORK", 2000)
    monkeypatch.setattr(near, "BROADCAST_BYTES", 0)
    test_matches_all_pairs(spark, 3, 85)


def test_deduplicated(spark):
    rows = corpus(2)
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id bigint, text string, component string, gone_id int")
    stay = near.deduplicated(docs, 3, 85)
    assert stay.columns == docs.columns
    groups = brute(rows, 3, 85)
    expected = {(i, c) for i, n, c in groups if n == 0 or i == c}
    got = [r.doc_id for r in stay.collect()]
    assert {i for i in got if i is not None} == {i for i, _ in expected if i is not None}
    assert got.count(None) == 1  # the lone row without an id; the other one has a group


def test_query_against_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in PLANS["op7_near"](spark, small).collect())
    assert got == sorted(brute([tuple(d) for d in docs], 3, 85))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert near.grouped(docs).count() == 0
    assert near.deduplicated(docs).count() == 0
    assert near.grouped(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")).count() == 2


def test_words_and_sets():
    for text in ["A b\tB  c", "x" * 5000 + " y", "É\u2003é z", "\x0b\x0cq"]:
        assert len(hashed.word_hashes(text)) == len(words(text))
        assert len(hashed.shingle_set(text, 2)) == len(shingles(text, 2))
    assert list(hashed.word_hashes("a b a")[[0]]) == list(hashed.word_hashes("z q A")[[2]])


def test_sketches_merge_and_estimate():
    draw = np.random.Generator(np.random.PCG64(7))
    pool = np.unique(draw.integers(0, 2**64, 30_000, dtype=np.uint64))
    for share in (0.3, 0.6, 0.85, 0.95):
        errors = []
        for k in range(30):
            part = draw.permutation(pool)[:2000]
            both = int(2000 * share)
            a, b = np.sort(part[:both + (2000 - both) // 2]), np.sort(np.append(part[:both], part[both + (2000 - both) // 2:]))
            errors.append(near.similarity(near.sketch(a), near.sketch(b)[None], len(a), np.array([len(b)]))[0] - share)
            assert (near.merged(near.sketch(a), near.sketch(b)) == near.sketch(np.union1d(a, b))).all()
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_bands_miss_little():
    for limit in (0.5, 0.7, 0.8, 0.85, 0.95):
        r = near.rows_per_band(limit)
        assert (1 - limit**r) ** (near.REGISTERS // r) <= near.MISS or r == 1


def test_components(spark, tmp_path):
    draw = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(100 + draw.randrange(80), 100 + draw.randrange(80)) for _ in range(70)]
    links += [(500, 501 + i) for i in range(50)] + [(900, 900), (None, 3)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        if a is not None:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(links, "a bigint, b bigint"), str(tmp_path))
    assert {(r.node, r.root) for r in got.collect()} == {(x, top(x)) for x in list(parent)}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), str(tmp_path / "none")).count() == 0
    assert got.select(F.countDistinct("node")).first()[0] == got.count()
