"""Counts against one plain call of the library per text."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sunloom.llm import token_counts
from sunloom.llm.queries import PLANS

TEXTS = [None, "", " ", "plain words\n\nand  more ", "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|> <|endoftext|>x", "é 日本語 ١٢٣   x",
         "x" * 5000, "word " * 3000, " \n" * 2000, "don't I'll 12345 !!??  \t tail   ", "ΑΣ ΑΣ. ſtraße İ ﬁ", "日本" * 4000 + " 日本" * 300]


def plain(path):
    if path.endswith(".json"):
        library = Tokenizer.from_file(path)
        return lambda text: len(library.encode(text or "", add_special_tokens=False).ids)
    library = SentencePieceProcessor(model_file=path)
    return lambda text: len(library.encode(text or ""))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("piece,batch", [(1 << 16, 1 << 20), (7, 50)])
def test_odd_texts(spark, monkeypatch, name, piece, batch):
    path = P.path(name)
    monkeypatch.setattr(token_counts, "PIECE_CHARS", piece)
    monkeypatch.setattr(token_counts, "BATCH_BYTES", batch)
    make = token_counts.json_counter if name.endswith(".json") else token_counts.model_counter
    with open(path, "rb") as f:
        count, split = make(f.read())
    assert split == (name == "byte_bpe_50k.json")
    assert token_counts.lengths(TEXTS, count, split).tolist() == [plain(path)(t) for t in TEXTS]


def test_pieces():
    for text in ("", "a", "abc def  ghi\n\njkl " * 9, " " * 50, "x" * 50, "a b\x1fc " * 20):
        for most in (1, 3, 10, 100):
            parts = list(token_counts.pieces(text, most))
            assert "".join(parts) == text
            assert all(p[0].isspace() and not q[-1].isspace() for q, p in zip(parts, parts[1:]))


def test_rows_and_clashes(spark):
    rows = [(1, "a b", 5), (1, "a b", 5), (None, None, None), (2, "x" * 9, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int").withColumn("content", F.lit("c"))
    path = P.path("byte_bpe_50k.json")
    got = token_counts.counted(docs, path, carry=("doc_id", "n_tokens", "content", "text"), limit=1)
    assert got.columns == ["doc_id", "content", "text", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, "c", t, len(t or ""), plain(path)(t), plain(path)(t) > 1) for i, t, _ in rows]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    assert token_counts.counted(docs.limit(0), path).count() == 0
    with pytest.raises(ValueError, match="tokenizer"):
        token_counts.counted(docs, "x.txt")


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    count = plain(P.path("byte_bpe_50k.json"))
    want = sorted((d.doc_id, len((d.text or "").encode()), count(d.text), count(d.text) > 1024) for d in docs)
    assert sorted(map(tuple, PLANS["op11_token_counts"](spark, small).collect())) == want
