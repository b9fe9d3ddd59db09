"""The pipeline on planted documents, stage by stage, against what each must keep."""

import random
import struct

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as pipeline
from sunloom.llm import bpe

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    draw = random.Random(8)
    syllables = ["an", "er", "th", "in", "é", "ol", "um"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    clean = {i: text(draw.randrange(20, 90)) for i in range(120)}
    item = text(30)
    toxic = {i: text(20) + draw.choice((" zork ", " blarg ")) + text(20) for i in range(200, 280)}
    copies = {300 + i: clean[i] for i in range(20)} | {340 + i: clean[0] for i in range(60)}
    near = {}
    for i in range(20, 40):
        words = clean[i].split()
        if len(words) > 60:
            words[3] = "changed"
            near[400 + i] = " ".join(words)
    leaked = {500 + i: text(15) + " " + " ".join(item.split()[i:i + 12]) + " " + text(15) for i in range(10)}
    odd = {600: None, 601: "", 602: "word"}
    rows = [(i, t, "en", "s", len(t or "")) for part in (clean, toxic, copies, near, leaked, odd) for i, t in part.items()]
    folder = tmp_path_factory.mktemp("planted")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 1) for i in toxic if i % 2] + [(i, 1, 0) for i in clean if i % 3]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), clean, toxic, copies, near, leaked


def test_stages(spark, planted, tmp_path):
    folder, clean, toxic, copies, near, leaked = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    left = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        got = stage(spark, docs, folder)
        if k < len(pipeline.STAGES) - 1:
            assert got.columns == columns
        got.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert not left["toxicity"] & set(toxic) and set(clean) <= left["toxicity"]
    assert left["exact_dedup"] == left["toxicity"] - set(copies) - {601}  # null counts as empty
    assert left["near_dedup"] == left["exact_dedup"] - set(near)
    assert left["decontaminate"] == left["near_dedup"] - set(leaked)
    ranks = bpe.parse_ranks(bpe.rank_file(P.path(pipeline.RANKS)))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in docs.collect():
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert list(struct.unpack(f"<{r.n_tokens}I", bytes(r.ids))) == ids and r.round_trip
    assert {r.doc_id for r in pipeline.run(spark, folder).collect()} == left["byte_level_bpe"] == left["decontaminate"]


def test_empty(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
