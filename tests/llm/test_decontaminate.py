"""Window scan against a scan of every position."""

import random
import re

import pytest

from sunloom.llm import decontaminate as dec
from sunloom.llm.common import ALNUM_WORDS, lower_words

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(words, items, width):
    hit, held = set(), set()
    for name, text in items:
        own = plain_words(text)
        if not own:
            continue
        size = min(width, len(own))
        for i in range(len(own) - size + 1):
            for j in range(len(words) - size + 1):
                if words[j:j + size] == own[i:i + size]:
                    hit.update(range(j, j + size))
                    held.add(str(name))
    return hit, held


def test_words():
    text = "A-b_c É日本 x\x7fy 9\u00a0z\x00Q\u2028r"
    assert [w.decode() for w in lower_words(text, ALNUM_WORDS)] == plain_words(text)


def test_random_documents(spark):
    draw = random.Random(3)
    vocabulary = ["a", "b", "c", "É", "1"]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, text(draw.randrange(0, 9))) for i in range(12)] + [(50, None), (51, ""), (52, "..."), (7, "a b a b a b a b")]
    docs = [(i, text(draw.randrange(0, 60)), "x") for i in range(80)] + [(900, None, "x"), (901, "", None), (None, text(30), "y")]
    docs += docs[:2]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = dec.scanned(table, bench, width=6).collect()
    assert len(got) == len(docs)
    for r in got:
        words = plain_words(r.text)
        hit, held = plain(words, items, 6)
        assert r.n_words == len(words)
        assert {w for s in r.hit_spans for w in range(s.start, s.stop)} == hit
        assert set(r.hit_items) == held and list(r.hit_items) == sorted(r.hit_items)


def test_clean(spark):
    long = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"Before, {long}! After.", 1), (2, "nothing here", 2), (3, None, 3), (4, long, 4)],
                                 "doc_id bigint, text string, n_words_before int")
    bench = spark.createDataFrame([(1, long)], "item_id bigint, text string")
    assert sorted(r.doc_id for r in dec.clean(docs, bench).collect()) == [2, 3]
    cut = {r.doc_id: r.text for r in dec.clean(docs, bench, remove="spans").collect()}
    assert cut == {1: "Before, ! After.", 2: "nothing here", 3: None, 4: ""}
    odd = docs.withColumnsRenamed({"n_words_before": "n_words"})
    assert dec.clean(odd, bench).columns == odd.columns and sorted(r.n_words for r in dec.clean(odd, bench).collect()) == [2, 3]
    assert dec.scanned(odd, bench).columns == ["doc_id", "text", "n_words", "hit_spans", "hit_items"]
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert dec.clean(docs, none).count() == 4
    assert dec.clean(spark.createDataFrame([], docs.schema), bench).count() == 0


def test_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(dec, "MOST_BYTES", 20)
    with pytest.raises(ValueError, match="split it"):
        dec.benchmark_items(spark.createDataFrame([(1, "x" * 50)], "item_id bigint, text string"))
