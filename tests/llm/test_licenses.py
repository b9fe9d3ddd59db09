"""Planted notices and near misses, odd tables."""

import re

import pytest

from sunloom.llm import licenses
from sunloom.llm.queries import PLANS

SCHEMA = "doc_id bigint, text string, family string"


@pytest.fixture(scope="module")
def corpus(spark):
    filler = [(i, "\n".join(f"Thoner w{(i * 7 + k) % 90} er the and of in{k}." for k in range(i % 6 + 1)), "x") for i in range(200)]
    planted = [(1000, "Thoner.\nReleased under the MIT License.\nMore.", "x"), (1001, "Licensed under the Apache License, Version 2.0.", None),
               (1002, "a\nThis work is licensed under the GNU General Public License, version 3.\nb\nLicensed under CC BY-NC 4.0.", "x"),
               (1003, "Released under the MIT License.\nReleased under the MIT License.", "x"), (1004, "He has a fishing license and permission to use the pond.", "x"),
               (1005, None, "x"), (1006, "", "x"), (None, "licensed under CC BY-NC 4.0", "x"), (1007, "word " * 30_000, "x"),
               (1000, "Thoner.\nReleased under the MIT License.\nMore.", "x"), (1008, "The license was published in the general public library.", "x")]
    return spark.createDataFrame(filler + planted, SCHEMA)


def test_planted(spark, corpus):
    got = licenses.scan(corpus).collect()
    assert len(got) == corpus.count()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append([n.family for n in r.notices])
        assert all(n.probability > 0.5 and licenses.LEAST_OVERLAP <= n.overlap <= 1 for n in r.notices)
    want = {1000: [["mit"]] * 2, 1001: [["apache-2.0"]], 1002: [["gpl-3.0", "cc-by-nc-4.0"]], 1003: [["mit", "mit"]], 1004: [[]], 1005: [[]], 1006: [[]],
            1007: [[]], 1008: [[]], None: [["cc-by-nc-4.0"]]}
    assert {k: v for k, v in found.items() if k in want} == want
    assert not any(x for k, v in found.items() if k is not None and k < 1000 for x in v)


def test_odd_tables(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = licenses.scan(spark.createDataFrame([(1, "Released under the MIT License.", 1, 2)], "doc_id bigint, text string, notices int, _row int"))
    assert odd.columns == ["doc_id", "_row", "notices"] and odd.first()._row == 2 and odd.first().notices[0].family == "mit"


def test_query(spark, small):
    got = {r.doc_id: r.families for r in PLANS["op8_licenses"](spark, small).collect()}
    lines = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0",
             "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
             "All rights reserved.": "proprietary"}
    for d in spark.read.parquet(f"{small}/documents.parquet").collect():
        want = sorted({f for line, f in lines.items() if re.search(rf"(?m)^{re.escape(line)}$", d.text)})
        assert list(got[d.doc_id]) == want, d.doc_id


RESERVED = "All rights reserved."


def test_reserved(spark, corpus):
    rows = [(2000, f"Thoner.\n{RESERVED}\nMore.", "x"), (2001, f"{RESERVED}\nReleased under the MIT License.", "x"), (2002, "All rights and duties pass to the heirs.", "x"),
            (2003, "All rooms were reserved.", "x"), (2004, "reserved", "x"), (2005, f"Copyright 2020 Thoner. {RESERVED}", "x")]
    got = {r.doc_id: [n.family for n in r.notices] for r in licenses.scan(corpus.union(spark.createDataFrame(rows, SCHEMA))).where("doc_id >= 2000").collect()}
    assert got == {2000: ["proprietary"], 2001: ["proprietary", "mit"], 2002: [], 2003: [], 2004: [], 2005: ["proprietary"]}
    lines = [tuple(r.tokens) for r in licenses.corpus_sample(corpus.union(spark.createDataFrame(rows, SCHEMA)).select("text"), "text").collect()]
    assert ("all", "rights", "reserved") not in lines and ("all", "rooms", "were", "reserved") in lines


def test_query_reserved(spark, small):
    got = {r.doc_id: r.families for r in PLANS["op8_licenses"](spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    with_line = {d.doc_id for d in docs if RESERVED in (d.text or "").split("\n")}
    assert with_line and {i for i, families in got.items() if "proprietary" in families} == with_line
