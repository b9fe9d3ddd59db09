"""Learnt embeddings against a dense factorisation."""

import numpy as np
from pyspark.sql import functions as F

from sunloom.retrieval import chunks, latent


def dense(lists, model):
    place = {t: i for i, t in enumerate(model.terms)}
    a = np.zeros((len(lists), len(place)))
    for i, found in enumerate(lists):
        for t in found:
            if t in place:
                a[i, place[t]] += 1
    a = np.log1p(a) * model.rarity
    length = np.linalg.norm(a, axis=1, keepdims=True)
    return np.divide(a, length, out=np.zeros_like(a), where=length > 0)


def test_singular_values_and_vectors(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.substring("text", 1, 2000).alias("chunk")).repartition(4)
    model = latent.fit(docs, str(tmp_path), components=20, vocabulary=3000, rounds=8)
    lists = docs.orderBy("doc_id").select(chunks.words(F.lower(F.coalesce("chunk", F.lit("")))).alias("w")).collect()
    lists = [r["w"] for r in lists]
    a = dense(lists, model)
    held = np.bincount([model.terms.index(t) for found in lists for t in set(found) if t in set(model.terms)], minlength=len(model.terms))
    assert np.allclose(model.rarity, np.log(len(lists) / held))
    values = np.linalg.svd(a, compute_uv=False)[:20]
    assert np.all(np.abs(model.values - values) <= 0.01 * values), (model.values, values)
    assert np.allclose(model.vectors.T @ model.vectors, np.eye(20), atol=1e-8)
    latent.save(model, spark, str(tmp_path / "m"))
    back = latent.load(spark, str(tmp_path / "m"))
    got = np.array([r["vector"] for r in latent.embed(docs, back).orderBy("doc_id").collect()])
    want = a @ model.vectors
    length = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, np.divide(want, length, out=np.zeros_like(want), where=length > 0), atol=1e-9)


def test_odd_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "pump valve pump"), (2, "valve seal"), (3, None), (4, ""), (5, "seal pump"), (5, "seal pump")], "id int, chunk string")
    model = latent.fit(docs, str(tmp_path), components=2)
    rows = {r["id"]: r["vector"] for r in latent.embed(docs.unionByName(spark.createDataFrame([(6, "unknown words")], docs.schema)), model).collect()}
    assert rows[3] == rows[4] == rows[6] == [0.0, 0.0] and abs(np.linalg.norm(rows[1]) - 1) < 1e-9
    none = latent.fit(docs.limit(0), str(tmp_path / "none"))
    assert latent.embed(docs, none).first()["vector"] == []


def test_shares_of_a_term_meet_as_rows(spark, tmp_path, monkeypatch):
    """Sums meet as one row per term and task, not as one row per number; texts travel as numbers of their terms."""
    docs = spark.createDataFrame([(i, f"pump valve{i % 5} seal{i % 3}") for i in range(60)], "id int, chunk string").repartition(3)
    seen = []
    monkeypatch.setattr(latent, "_gathered", lambda stored, *rest, known=latent._gathered: seen.append(stored.schema.simpleString()) or known(stored, *rest))
    model = latent.fit(docs, str(tmp_path), components=4, rounds=2)
    assert set(seen) == {"struct<__at:array<int>>"} and len(seen) == 3
    assert np.allclose(model.vectors.T @ model.vectors, np.eye(4), atol=1e-8)


def test_words_are_counted_where_they_are_split(spark, tmp_path, monkeypatch):
    """Counts of texts by term from slices of texts, with separators at the ends, repeated words and words that lower case joins."""
    texts = [" Pump valve\tpump ", "VALVE seal", None, "", "\x1c\x85", "seal pump", "Ärger ärger"] * 9
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, chunk string").repartition(3)
    lists = docs.select(chunks.words(F.lower(F.coalesce("chunk", F.lit("")))).alias("w"))
    expected = {r["t"]: r["n"] for r in lists.select(F.explode(F.array_distinct("w")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    for size, most in ((latent.TEXT_BYTES, latent.TERMS), (16, 3), (16, 1)):
        monkeypatch.setattr(latent, "TEXT_BYTES", size)
        monkeypatch.setattr(latent, "TERMS", most)
        model = latent.fit(docs, str(tmp_path / f"{size}-{most}"), components=2)
        assert model.terms == sorted(expected, key=lambda t: (-expected[t], t))
        assert np.allclose(model.rarity, [np.log(len(texts) / expected[t]) for t in model.terms])
        # no table of words is written
        assert [p.name for p in (tmp_path / f"{size}-{most}").iterdir()] == ["places"]


def test_sparse_products():
    draw = np.random.default_rng(2)
    row, term = np.divmod(np.sort(draw.choice(60 * 40, 900, replace=False)), 40)
    row, weight = row + (row > 20) * 5, draw.normal(size=900)
    a = np.zeros((70, 40))
    a[row, term] = weight
    block = draw.normal(size=(40, 7))
    right = latent.times((row, term, weight), 70, block)
    assert np.allclose(right, a @ block)
    for many in (1, latent.MANY, 1000):
        latent.MANY, before = many, latent.MANY
        try:
            assert np.allclose(latent.back((row, term, weight), right, 40), a.T @ right)
        finally:
            latent.MANY = before
