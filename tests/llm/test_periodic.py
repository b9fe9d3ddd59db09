"""Runs against a plain search over all periods."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sunloom.llm import periodic
from sunloom.llm.queries import PLANS


def plain_runs(words):
    """(start, length, period) of maximal stretches, period by period; a period that a smaller one divides is not the smallest."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(
                    all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def found_runs(words):
    return [tuple(r) for r in periodic.runs_of(periodic.word_numbers(words, 0), len(words)).tolist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=9), st.integers(1, 9)), max_size=5))
def test_repetitions(parts):
    words = [w for root, times in parts for w in root * times]
    assert found_runs(words) == plain_runs(words)


def test_long_periods_and_powers():
    draw = np.random.Generator(np.random.PCG64(5))
    for period in [*range(1, 40), 63, 64, 65, 100]:
        root = [b"%d" % x for x in draw.integers(0, 50, period)]
        words = [b"x", b"y"] + root * 5 + root[:period // 2] + [b"z"]
        assert found_runs(words) == plain_runs(words)
    assert found_runs([b"a"] * 10_000) == [(0, 10_000, 1)]
    fibonacci, before = [b"a", b"b"], [b"a"]
    while len(fibonacci) < 600:
        fibonacci, before = fibonacci + before, fibonacci
    assert found_runs(fibonacci) == plain_runs(fibonacci)


def expected(words):
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, " ".join(w.decode() for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("slice_bytes", [2 << 20, 40])
def test_odd_rows(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(periodic, "SLICE_BYTES", slice_bytes)
    texts = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", " x y " * 4, "A a " * 4, "a\x0bb\x0ca\rb a\tb a b", "a a " * 6,
             "é " * 3000 + "f", "a b c d " * 2500, "p q r p q r p q r p q", "no repeats here at all"]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(0, None, "k"), (None, "b b b b b b", "k")],
                                 "doc_id bigint, text string, runs string").withColumn("ident", F.lit(1)).repartition(3)
    got = periodic.detected(docs, carry=("doc_id", "runs", "ident", "text"))
    assert got.columns == ["doc_id", "ident", "text", "runs", "n_words", "collapsed"]
    rows = got.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        words = (r.text or "").encode().split()
        runs, collapsed = expected(words)
        assert ([tuple(x) for x in r.runs], r.n_words, r.collapsed) == (runs, len(words), collapsed), r.doc_id
    assert periodic.detected(docs.limit(0)).count() == 0


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in PLANS["op13_periodic"](spark, small).collect()}
    assert len(got) == len(docs)
    tops = 0
    for d in docs:
        words = (d.text or "").encode().split()
        if len(words) > 3000:  # the plain search is quadratic
            continue
        h = zlib.crc32(str(d.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs, collapsed = expected(words)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        tops += top is not None
        want = (len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), hashlib.sha256(lines.encode()).hexdigest(),
                hashlib.sha256(collapsed.encode()).hexdigest())
        assert got[d.doc_id] == want, d.doc_id
    assert tops > 5
