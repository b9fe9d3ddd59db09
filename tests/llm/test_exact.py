"""Content sort against a dictionary of texts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sunloom.llm import exact

SCHEMA = "doc_id bigint, text string, source string"


def table(spark):
    """Hot text, equal beginnings, nulls, ties, repeated rows, a missing id."""
    head = "x" * 200
    rows = [(i, "hot text", "a") for i in range(300)] + [(1000 + i, head + str(i % 40), None) for i in range(120)]
    rows += [(2000, None, "b"), (2001, "", "b"), (2002, "", None), (3000, "twice", "c"), (3000, "twice", "c"), (None, "no id", "d"),
             (4000, "é" * 50_000, "e"), (4001, "é" * 50_000 + "f", "e"), (4002, "é" * 50_000, "e"), (None, "hot text", "z")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), rows


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("parts", [1, 4, 60])
def test_matches_dictionary(spark, keep, parts):
    docs, rows = table(spark)
    groups = {}
    for i, text, _ in rows:
        groups.setdefault(text or "", []).append(i)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = exact.marked(docs, keep=keep, carry=("doc_id", "text")).collect()
        stay = exact.deduplicated(docs, keep=keep).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r.text or ""]
        known = [i for i in ids if i is not None]
        best = (min if keep == "smallest" else max)(known) if known else None
        assert (r.keep_id, r.group_size) == (best, len(ids))
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert not r.kept or r.doc_id == best
    assert sum(r.kept for r in got) == len(groups) == len(stay)
    assert {r.text or "" for r in stay} == set(groups)
    assert {r.doc_id for r in stay} == {r.doc_id for r in got if r.kept}


def test_normal_form_and_clashes(spark):
    docs = spark.createDataFrame([(1, " A  b", "x"), (2, "a B ", "y")], SCHEMA)
    assert exact.marked(docs, normal=exact.trimmed_lower(F.col("text"))).where("kept").count() == 1
    assert exact.deduplicated(docs).columns == docs.columns
    odd = docs.withColumns({n: F.lit(7) for n in ("kept", "packed", "_data", "_id", "_sha", "_part", "_run", "keep_id")})
    got = exact.marked(odd, carry=("doc_id", "kept", "_data"))
    assert got.columns == ["doc_id", "_data", "keep_id", "group_size", "kept", "text_sha256"] and got.where("kept").count() == 2
    left = exact.deduplicated(odd)
    assert left.columns == odd.columns and {tuple(r)[3:] for r in left.collect()} == {(7,) * 8}
    with pytest.raises(ValueError, match="smallest"):
        exact.marked(docs, keep="any")


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact.marked(docs).count() == 0
    assert exact.deduplicated(docs).count() == 0
