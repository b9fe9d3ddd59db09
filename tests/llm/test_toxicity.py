"""n-gram counts and scores against plain Python, the regression against its gradient, held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.llm import toxicity as tox
from sunloom.llm.queries import PLANS


def plain_grams(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    data = b" " + low.encode() + b" "
    return {(n, data[i:i + n]) for n in tox.ORDERS for i in range(len(data) - n + 1)}


def number(gram):
    code = 0
    for b in gram[1]:
        code = code * 257 + b
    return code * 8 + gram[0]


def corpus(n=400, start=0):
    draw = random.Random(start)
    docs, labels = [], []
    for i in range(start, start + n):
        words = ["".join(draw.choice(("an", "er", "th", "in", "é")) for _ in range(draw.randrange(1, 4))) for _ in range(draw.randrange(3, 80))]
        toxic = draw.random() < 0.3
        if toxic:
            words.insert(draw.randrange(len(words)), draw.choice(("zork", "Blarg")))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.mark.parametrize("text", ["", None, "A", "Ab é b", "aa" * 40, "x y\nz"])
def test_grams(text, monkeypatch):
    want = sorted(number(g) for g in plain_grams(text))
    assert tox.text_grams(text).tolist() == want
    monkeypatch.setattr(tox, "_WINDOW", 3)
    assert tox.text_grams(text).tolist() == want


def test_scores_against_plain(monkeypatch):
    chosen = [(3, b"ork"), (4, b" bla"), (5, b"an er"), (3, b"  x"), (3, b"\xc3\xa9 ")]
    keys = np.array(sorted(number(g) for g in chosen), np.uint64)
    adds = np.arange(1.0, 6)
    texts = [d[1] for d in corpus(50)[0]] + [None, "", " x", "zork", "é", "an er blarg é " * 30]
    model = tox.Model(keys, adds, -2.0)
    want = [-2.0 + sum(adds[k] for k, key in enumerate(keys.tolist()) if key in {number(g) for g in plain_grams(t)}) for t in texts]
    assert model.log_odds(texts) == pytest.approx(want)
    monkeypatch.setattr(tox, "_WINDOW", 7)
    assert model.log_odds(texts) == pytest.approx(want)
    assert tox.Model(keys[:0], adds[:0], 0.5).log_odds(texts).tolist() == [0.5] * len(texts)


def test_regression_reaches_the_minimum():
    draw = np.random.Generator(np.random.PCG64(1))
    sets = [np.flatnonzero(draw.random(6) < 0.4) for _ in range(300)]
    labels = np.array([float(0 in s) if draw.random() < 0.9 else 1.0 for s in sets])
    offsets, features, ratios = np.append(0, np.cumsum([len(s) for s in sets])), np.concatenate(sets), np.array([2, 1, 1, -1, 0.5, 3.0])
    weights, bias = tox.regression(offsets, features, ratios, labels)
    x = np.zeros((300, 6))
    for k, s in enumerate(sets):
        x[k, s] = ratios[s]
    miss = 1 / (1 + np.exp(-(x @ weights + bias))) - labels
    assert np.abs(x.T @ miss / 300 + tox.PENALTY * weights).max() < 1e-4 and abs(miss.mean()) < 1e-4


def test_ratios(spark):
    docs, labels = corpus(60)
    docs += [(900, None, "x")]
    train = spark.createDataFrame([(d[1], dict(labels).get(d[0], 0)) for d in docs], "text string, label int")
    keys, ratios, toxic, clean = tox.log_count_ratios(train)
    sets = [(plain_grams(d[1]), dict(labels).get(d[0], 0)) for d in docs]
    by_key = {}
    for s, y in sets:
        for g in s:
            by_key.setdefault(number(g), [0, 0])[1 - y] += 1
    assert (toxic, clean) == (sum(y for _, y in sets), sum(1 - y for _, y in sets))
    for key, r in zip(keys.tolist(), ratios):
        p, q = by_key[key]
        assert p + q >= tox.LEAST_TEXTS
        assert r == pytest.approx(math.log((p + 1) / (toxic + 2)) - math.log((q + 1) / (clean + 2)))


def test_learns_planted_words(spark, monkeypatch):
    docs, labels = corpus()
    more, truth = corpus(200, 5000)
    table = spark.createDataFrame(docs + docs[:5], "doc_id bigint, text string, toxic string")
    given = spark.createDataFrame(labels + [(1, None), (None, 1), (77_777, 1)], "doc_id bigint, toxic int")
    for most in (20_000, 150):
        monkeypatch.setattr(tox, "TRAIN_ROWS", most)
        model = tox.fit(table, given)
        got = tox.scored(spark.createDataFrame(more, "doc_id bigint, text string, toxic string"), model).collect()
        right = [(r.score >= tox.THRESHOLD) == (dict(truth)[r.doc_id] == 1) for r in got]
        assert np.mean(right) > 0.97


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.score for r in tox.scored(docs, tox.fit(docs, none)).collect()] == [0.5] * 3
    one = spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")
    assert {round(r.score, 6) for r in tox.scored(docs, tox.fit(docs, one)).collect()} == {round(1 / 3, 6)}
    assert tox.scored(spark.createDataFrame([], docs.schema), tox.fit(docs, one)).count() == 0
    assert tox.scored(docs.withColumn("score", F.lit(1)), tox.fit(docs, none)).select("score").distinct().first()[0] == 0.5


def test_query(spark, small):
    got = PLANS["op3_toxicity"](spark, small).collect()
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in PLANS["op3_toxicity"](spark, folder).collect()}
    labels = [(r.toxic, got[r.doc_id].score) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()
              if r.doc_id in got and got[r.doc_id].held_out]
    toxic, clean = np.array([s for y, s in labels if y]), np.array([s for y, s in labels if not y])
    ranked = (toxic[:, None] > clean).mean() + (toxic[:, None] == clean).mean() / 2
    assert ranked > 0.75 and (clean >= 0.3).mean() < 0.02
