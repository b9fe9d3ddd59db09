"""The rank queue against a plain merge loop and the public library; whole-table round trip."""

import base64
import hashlib
import random
import struct

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from sunloom.llm import bpe, chunk_ids
from sunloom.llm.queries import PLANS

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.parse_ranks(bpe.rank_file(RANKS))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def coded(chunks, texts):
    ids, counts = chunks.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts).tolist()
    return [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]


CASES = ["", " ", "a", "  a  b ", "\n\n x\t\ty \n", "don't we'll I'M 'sx", "aa" * 5000, "ab" * 3000 + "é" * 2000, "0123456789" * 300,
         " 　 z\x1c \x1dq", "日本語 テキスト 🙂🙂 ‍", "x" * 200 + " " * 300 + "y", "!!!??? ...\r\n", "Ñé ßü\x85 a b", "<|endoftext|> a"]


@pytest.mark.parametrize("text", CASES)
def test_matches_library(ranks, library, text):
    assert coded(bpe.coder(ranks, P.PATTERN), [text]) == [library.encode_ordinary(text)]


def test_random_texts(ranks, library):
    draw, chunks = random.Random(5), bpe.coder(ranks, P.PATTERN)
    pool = "abcdeé ß\n\t '.!1²٣日  \x1c\x85́\u2003"
    texts = ["".join(draw.choice(pool) for _ in range(draw.randrange(60))) for _ in range(400)]
    want = [library.encode_ordinary(t) for t in texts]
    assert coded(chunks, texts) == want
    assert [coded(chunks, [t])[0] for t in texts] == want  # now from the table


def test_every_character(ranks, library):
    chunks = bpe.coder(ranks, P.PATTERN)
    for start in [*range(0, 0x3100, 64), *range(0xA700, 0xAC00, 64), *range(0x10700, 0x20000, 64), *range(0x2B700, 0x40000, 1024), 0xE0000]:
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        assert coded(chunks, [text]) == [library.encode_ordinary(text)], hex(start)


def test_plain_loop(ranks):
    draw, pieces, want = random.Random(1), [], []
    for _ in range(200):
        piece = bytes(draw.choice(b"aeinrst\xc3\xa9") for _ in range(draw.randrange(1, 40)))
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                break
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        pieces.append(piece)
        want.append([ranks[p] for p in parts])
    for group in (pieces, pieces[:1], pieces * 2):
        ids, counts = bpe.merge_all(group, bpe.Pairs(ranks))
        ends = np.cumsum(counts).tolist()
        assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == (want * 2)[:len(group)]


def test_lower_ranks_that_merges_make():
    """Vocabularies in any order of ranks, so that a merge often makes a pair of a lower rank; runs of one byte overlap."""
    for seed in range(60):
        draw = random.Random(seed)
        tokens = {bytes([x]) for x in b"abc"} | {bytes(draw.choice(b"abc") for _ in range(draw.randrange(2, 6))) for _ in range(25)}
        order = sorted(tokens)
        draw.shuffle(order)
        ranks = {t: i for i, t in enumerate(order)}
        pieces = [bytes(draw.choice(b"aaabc") for _ in range(draw.randrange(1, 60))) for _ in range(15)]
        ids, counts = bpe.merge_all(pieces, bpe.Pairs(ranks))
        ends = np.cumsum(counts).tolist()
        for piece, a, b in zip(pieces, [0, *ends], ends):
            parts = [piece[i:i + 1] for i in range(len(piece))]
            while True:
                best = min(((ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks), default=None)
                if best is None:
                    break
                parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            assert ids[a:b].tolist() == [ranks[p] for p in parts], (seed, piece)


def test_small_table_gives_the_same(ranks, library, monkeypatch):
    """Chunks that meet in one place, chunks with more ids than a place holds, segments of a few bytes, few pieces kept."""
    for places, wide, segment in ((1, 12, 1 << 21), (4, 1, 64), (2, 3, 1)):
        monkeypatch.setattr(chunk_ids, "PLACES", places)
        monkeypatch.setattr(chunk_ids, "WIDE", wide)
        monkeypatch.setattr(chunk_ids, "SEGMENT", segment)
        monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
        chunks = bpe.coder(ranks, P.PATTERN)
        texts = ["one two three four five six one two three four five six " * 3, "", "  six\u3000 seven " + "antidisestablishmentarianism" * 5, None]
        for _ in range(2):
            assert coded(chunks, texts) == [library.encode_ordinary(t or "") for t in texts]


def test_equal_hashes_are_no_equal_chunks(ranks, library, monkeypatch):
    """Where the first hash says equal and the second does not, chunks are encoded one by one."""
    hashes = chunk_ids.chunk_hashes
    monkeypatch.setattr(chunk_ids, "chunk_hashes", lambda *a: [np.zeros_like(hashes(*a)[0]), hashes(*a)[1]])
    chunks, texts = bpe.coder(ranks, P.PATTERN), ["one two three", "four one two", "two"]
    for _ in range(2):
        assert coded(chunks, texts) == [library.encode_ordinary(t) for t in texts]


def test_decode(ranks):
    tokens = chunk_ids.TokenBytes({i: t for t, i in ranks.items()})
    ids = np.arange(300, dtype="<u4")
    spelled = {i: t for t, i in ranks.items()}
    assert tokens.decode(ids, np.array([100, 0, 200])).to_pylist() == [b"".join(map(spelled.get, range(100))), b"",
                                                                      b"".join(map(spelled.get, range(100, 300)))]
    assert tokens.decode(ids[:0], np.array([0, 0])).to_pylist() == [b"", b""]
    with pytest.raises(ValueError, match="vocabulary"):
        tokens.decode(np.array([1 << 20], "<u4"), np.array([1]))


def test_query_against_library(spark, small, library):
    rows = PLANS["op1_bpe"](spark, small).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    assert len(rows) == len(docs)
    for doc in docs.itertuples():
        text = doc.text or ""
        ids = library.encode_ordinary(text)
        row = rows.loc[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_tables(spark):
    schema = "doc_id bigint, text string, part string"
    rows = [(1, None, "x"), (None, "", None), (2, "hello  world", "y"), (2, "hello  world", "y")]
    coded = bpe.encode(spark.createDataFrame(rows, schema), RANKS, P.PATTERN)
    got = bpe.decode(coded, RANKS).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, bytes(r.decoded)) for r in got) == [
        (0, 0, b""), (1, 0, b""), (2, got[-1].n_tokens, b"hello  world"), (2, got[-1].n_tokens, b"hello  world")]
    assert coded.columns == ["doc_id", "text", "part", "ids", "n_tokens"]
    empty = bpe.decode(bpe.encode(spark.createDataFrame([], schema), RANKS, P.PATTERN), RANKS)
    assert empty.count() == 0
    both = bpe.round_trip(spark.createDataFrame(rows, schema), RANKS, P.PATTERN)
    assert both.columns == [*coded.columns, "decoded"] and sorted(map(str, both.drop("text", "part").collect())) == sorted(
        map(str, bpe.decode(coded, RANKS).drop("text", "part").collect()))
    assert bpe.round_trip(spark.createDataFrame([], schema), RANKS, P.PATTERN).count() == 0
    clash = bpe.encode(spark.createDataFrame([(1, "a", 2)], "doc_id bigint, text string, ids int"), RANKS, P.PATTERN)
    assert clash.columns == ["doc_id", "text", "ids", "n_tokens"] and clash.first().n_tokens == 1
    with pytest.raises(ValueError, match="name of an input"):
        bpe.encode(spark.createDataFrame([("a",)], "ids string"), RANKS, P.PATTERN, text="ids")


def test_rank_file_lines():
    assert bpe.parse_ranks(base64.b64encode(b"ab") + b" 7\n") == {b"ab": 7}
