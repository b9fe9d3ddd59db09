"""Round trip through files against the library."""

import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sunloom.llm import tokenbin
from sunloom.llm.queries import PLANS

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, rows):
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def round_trip(spark, docs, folder):
    tokenbin.write(tokenbin.encode(docs, PATH, 0, folder), 50257, folder)
    return tokenbin.read(spark, folder)


def test_pack():
    draw = np.random.Generator(np.random.PCG64(1))
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (draw.integers(0, 2**32, n) >> draw.integers(0, 32, n)).astype(np.uint32)
        assert (tokenbin.unpack(*tokenbin.pack(ranks), n) == ranks).all()


def test_every_character(library):
    data = tokenbin.rank_file(PATH)
    chunks = tokenbin.library_chunks(data, tokenbin.whole_strings(data), "<u4")
    for start in [*range(0, 0x3100, 256), 0xFE00, 0xFF00, 0x10E00, 0x1F600, 0xE0000]:  # all kinds of white space, some of the rest
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in range(start, start + 256))
        special = "a<|endoftext|>b.c endoftext|> x<|endoftext|>, don't've"
        ids, counts = chunks.encode(pa.array([text, special, None]))
        want = [library.encode(t, add_special_tokens=False).ids for t in (text, special, "")]
        assert (ids.tolist(), counts.tolist()) == (sum(want, []), list(map(len, want))), hex(start)


@pytest.mark.parametrize("ids_per_block,per_file", [(1 << 20, 32), (40, 2)])
def test_odd_documents(spark, library, tmp_path, monkeypatch, ids_per_block, per_file):
    monkeypatch.setattr(tokenbin, "CALL", 20)
    rows = [(i * 37 % 101, f"text {i} " + "word " * (i % 7)) for i in range(101)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (None, "no id"), (503, "x" * 30_000), (504, "<|endoftext|> é 日本 a <|endoftext|>b"), (-5, "negative")]
    docs = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id bigint, text string, n_tokens string").repartition(4)
    monkeypatch.setattr(tokenbin, "BLOCK_IDS", ids_per_block)
    monkeypatch.setattr(tokenbin, "BLOCKS_PER_FILE", per_file)
    got = round_trip(spark, docs, str(tmp_path / "run")).collect()
    have = sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got), key=lambda r: r[1])
    assert have == expected(library, rows)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tokenbin.whole_strings(tokenbin.rank_file(P.path("word_bpe_49k.json")))


def test_repeated_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c")], "doc_id bigint, text string")
    got = sorted((r.start, r.doc_id) for r in round_trip(spark, docs, str(tmp_path / "run")).collect())
    assert got == [(0, 1), (3, 1), (6, 2)]


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert round_trip(spark, docs, str(tmp_path / "run")).count() == 0


def test_frequent_ids_take_a_byte(spark, tmp_path):
    docs = spark.createDataFrame([(i, "the of and " * 500) for i in range(20)], "doc_id bigint, text string")
    round_trip(spark, docs, str(tmp_path / "run"))
    size = sum(p.stat().st_size for p in (tmp_path / "run" / "data").glob("part-*"))
    assert size < 20 * 1501 * 1.3 + 5000


def test_query_against_library(spark, small, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in PLANS["op4_token_files"](spark, small).collect()))
    assert got == expected(library, docs)
