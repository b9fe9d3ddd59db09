"""The vector index against a full scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.operators import ranking
from sunloom.retrieval import chunks, search, store


def full_scan(ids, x, wanted, k):
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    out = {}
    for q in wanted:
        cosine = np.round(u @ u[q], 12)
        out[ids[q]] = [(ids[i], cosine[i]) for i in np.lexsort((ids, -cosine))[:k]]
    return out


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 10))
    x = np.round(centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 10)) * 0.4, 3)
    x[100:400] = x[100]  # a third are copies of one vector
    ids = np.arange(900) * 3
    return ids, x, spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id bigint, embedding array<float>").repartition(4).cache()


def results(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["item"], r["score"]))
    return out


@pytest.mark.parametrize("block", [50_000, 70])
def test_exact_equals_full_scan(spark, table, tmp_path, monkeypatch, block):
    monkeypatch.setattr(store, "BLOCK", block)
    ids, x, df = table
    x = x.astype("float32").astype("float64")
    store.build(df, str(tmp_path / "s"))
    held = store.load(spark, str(tmp_path / "s"))
    assert held.counts.sum() == 900 and len(held.centres) == 60
    asked = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = results(store.search(held, asked, 5, probes=2, exact=True, folder=str(tmp_path)))
    want = full_scan(ids, x, [i for i in range(900) if ids[i] % 20 == 0], 5)
    assert got.keys() == want.keys()
    for q, hits in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in hits], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in hits], atol=1e-9)


def test_recall_and_pruning(spark, small, tmp_path):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding")
    held = store.build(vectors, str(tmp_path / "s"))
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    near = store.search(held, asked, 5)
    got = results(near)
    want = {}
    for r in search.top_k(vectors, asked, 5).collect():
        want.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = np.mean([len({i for i, _ in got.get(q, [])} & items) / len(items) for q, items in want.items()])
    assert recall >= 0.9, recall
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() or "PartitionFilters: [isnotnull(cell" in plan


def test_few_vectors_and_none(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    held = store.build(df, str(tmp_path / "s"))
    asked = df.withColumnRenamed("vec_id", "query_id")
    assert {q: [i for i, _ in h] for q, h in results(store.search(held, asked, 5, exact=True)).items()} == {1: [1, 2], 2: [2, 1]}
    assert store.search(held, asked.limit(0), 5).count() == 0
    with pytest.raises(ValueError, match="needs vectors"):
        store.build(df.limit(0), str(tmp_path / "none"))


def test_row_at(spark, monkeypatch):
    """Any place of the order, also among rows that share one instant."""
    rows = [(i, (i * 7919) % 500 if i % 3 else 250) for i in range(3000)]
    df = spark.createDataFrame(rows, "i bigint, s bigint").select("i", F.timestamp_seconds("s").alias("ts")).repartition(4).cache()
    order = sorted((s, i) for i, s in rows)
    for limit in (100_000, 300):
        monkeypatch.setattr(ranking, "LAST_ROWS", limit)
        for at in (0, 1, 700, 1499, 1700, 2999):
            cut = ranking.row_at(df, "ts", "i", at)
            assert (int(cut[0].timestamp()), cut[1]) == order[at]
            assert df.where(ranking.earlier("ts", "i", cut)).count() == at
        assert ranking.row_at(df, "ts", "i", 3000) is None
    assert df.where(ranking.earlier("ts", "i", None)).count() == 3000


def test_best_of_search_with_ties():
    rng = np.random.default_rng(1)
    x, queries = np.round(rng.normal(size=(400, 3))), rng.normal(size=(5, 3))
    best = search._Best(["a", "b", "c", "d", "e"], queries, 4)
    for at in range(0, 400, 37):
        best.add(np.arange(at, min(at + 37, 400)), list(x[at:at + 37]))
    hits = next(best.hits())
    cosine = np.round((x @ queries.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(queries, axis=1) + 1e-9), 12)
    for q, name in enumerate("abcde"):
        assert hits[hits["query"] == name]["item"].tolist() == np.lexsort((np.arange(400), -cosine[:, q]))[:4].tolist()


def test_groups_and_entries_are_bounded(spark, table, tmp_path, monkeypatch):
    """Queries meet a block in groups of bounded size, a task makes few entries at a time, a cell is one file; hits stay those of a full scan."""
    monkeypatch.setattr(store, "GROUP", 20)
    monkeypatch.setattr(store, "ENTRIES", 50)
    ids, x, df = table
    held = store.build(df, str(tmp_path / "index"), cells=12)
    assert len(list((tmp_path / "index" / "vectors").rglob("*.parquet"))) <= 2 * len(list((tmp_path / "index" / "vectors").glob("cell=*")))
    queries = df.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    parts = -(-queries.count() // 20)
    asked = store._asked(held, queries, "query_id", "embedding", 12, False, parts)
    assert asked.groupBy("cell", "block", "part").count().agg({"count": "max"}).first()[0] <= 3 * 20
    wanted = [i for i in range(900) if ids[i] % 5 == 0]
    got, want = results(store.search(held, queries, 4, exact=True)), {int(ids[q]): hits for q, hits in zip(wanted, full_scan(ids, x, wanted, 4).values())}
    assert [[i for i, _ in got[q]] for q in sorted(got)] == [[int(i) for i, _ in want[q]] for q in sorted(want)]


def test_scores_are_ordered_only_once(monkeypatch):
    """After the first slice only what reaches the k-th score so far is looked at, with ties, a zero query and zero vectors (F15)."""
    calls, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda *a, **kw: calls.append(1) or partition(*a, **kw))
    rng = np.random.default_rng(4)
    x, queries = np.round(rng.normal(size=(900, 3))), np.vstack([rng.normal(size=(4, 3)), np.zeros(3)])
    order = rng.permutation(900)
    best = search._Best(list("abcde"), queries, 6)
    for at in range(0, 900, 50):
        part = order[at:at + 50]
        best.add(part, list(x[part]))
    assert len(calls) == 1
    hits = next(best.hits())
    cosine = np.round((x @ queries.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(queries, axis=1) + 1e-9), 12)
    for q, name in enumerate("abcde"):
        assert hits[hits["query"] == name]["item"].tolist() == np.lexsort((np.arange(900), -cosine[:, q]))[:6].tolist()


def test_missing_numbers_of_vectors_do_not_hide_later_hits():
    best = search._Best(["a"], np.array([[1.0, 0.0]]), 2)
    best.add(np.array([1, 2]), [np.array([np.nan, 1.0]), np.array([np.nan, 1.0])])
    best.add(np.arange(3, 9), [np.array([1.0, float(i)]) for i in range(6)])
    assert next(best.hits())["item"].tolist() == [3, 4]


def test_texts_of_hits_are_not_moved(spark, table, tmp_path):
    ids, x, df = table
    texts = df.select("vec_id", F.concat(F.lit("text "), "vec_id").alias("chunk"))
    asked = df.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    store.build(df, str(tmp_path / "s"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for hits in (search.top_k(df, asked, 3), store.search(store.load(spark, str(tmp_path / "s")), asked, 3).withColumnRenamed("item", "vec_id")):
            told = search.context_text(hits.join(texts, "vec_id"), "query_id", queries=asked.select("query_id"))
            plan = told._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin [vec_id" in plan, plan
            assert told.where("context LIKE 'text %'").count() == 9
        few = search.top_k(df, asked, 3, block_bytes=100)
        assert "BroadcastHashJoin [vec_id" not in few.join(texts, "vec_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_separators_of_the_matcher_are_those_of_the_sql(spark):
    rows = [(c, chr(c)) for c in range(0x11000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame(rows, "c int, s string")
    assert df.where(F.col("s").rlike(chunks.SPACE) != F.col("s").rlike(chunks.SPLIT)).count() == 0
    assert df.where(F.col("s").rlike(chunks.SPLIT)).count() == 29
    text = spark.createDataFrame([("a\u2003\u00a0b\u200bc\x1f \x85d\u3000",), (None,), ("",)], "t string")
    assert [r[0] for r in text.select(chunks.words(F.col("t"))).collect()] == [["a", "b\u200bc", "d"], None, []]


def test_stored_counts_give_the_same_vectors(spark, tmp_path):
    texts = spark.createDataFrame([(1, "a b b C"), (2, "c a\u2003d"), (3, ""), (4, "x")], "key int, chunk string")
    counts = chunks.counted(texts, size=16)
    counts.write.parquet(str(tmp_path / "counts"))
    counts = spark.read.parquet(str(tmp_path / "counts"))
    plain, stored = chunks.fit_embedder(texts, size=16), chunks.fit_embedder(counts, size=16)
    chunks.save_store(chunks.embed(counts, stored), stored, str(tmp_path / "s"))
    kept, model = chunks.load_store(spark, str(tmp_path / "s"))
    assert kept.columns == ["key", "chunk", "vector"]
    want = {r["key"]: r["vector"] for r in chunks.embed(texts, plain).collect()}
    assert {r["key"]: r["vector"] for r in kept.collect()} == want == {r["key"]: r["vector"] for r in chunks.embed(texts, model).collect()}
    assert abs(sum(v * v for v in want[1]) - 1) < 1e-12 and not any(want[3])
