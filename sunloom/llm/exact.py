"""Exact duplicates by a content sort.

`marked` range-partitions rows by their normalised bytes with sampled splitters, sorts every partition (Spark's external
sort: it spills), so equal texts are neighbours, and compares each text with the one before it in full. Of a run of
equal texts one row stays.

* The order is (first 64 bytes, SHA-256, id): equal texts are adjacent in it whatever follows their first bytes, and the
  sample that the splitters come from holds about 100 bytes a row, not texts. The id breaks ties, so a text that a third
  of all rows share is cut over as many partitions as its rows fill.
* A run that a partition border cuts is joined again: every partition reports its first and its last run, with their texts.
  A window over the digests of these - two rows per partition, whatever the number of documents - proposes neighbours over
  the borders, a join compares their texts in full, and runs that go on are chained.
* Texts stream through the tasks. `marked` holds its small columns of one partition, `deduplicated` one row. A text travels
  once: where it is compared as it is, it is read out of the row that is kept.

Defined cases: null text counts as empty text, which is a text like any other. A row without an id stays only if no equal
row has one (`keep_id` is null then). Of rows that repeat in id and text exactly one stays. Carried columns named like an
output give way to it, `deduplicated` returns all columns. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sunloom.llm.common import as_batch, forget, output_schema, packed, run_folder, staged, unpacked

PREFIX_BYTES = 64
_RUN = "_sha string, _run bigint, _edge boolean, _text binary"
_OUT = (("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"), ("text_sha256", "string"))


def trimmed_lower(text: Column) -> Column:
    """A usual normal form: lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _runs(schema: pa.Schema):
    """Every row of a sorted partition of (packed, _id, _sha, _data), with the size of its run of equal texts and the id that
    comes first in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, starts, first, last, count = [], [], None, None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            text = batch.column(3)
            starts.append(np.flatnonzero(_changes(text, last)) + count)
            first = text[0].as_py() if first is None else first
            last = text[n - 1].as_py()
            held.append(batch.select([0, 1, 2]))
            count += n
        if not count:
            return
        start = np.concatenate(starts)
        size = np.diff(np.append(start, count))
        of_row = np.repeat(np.arange(len(start)), size)
        best = pa.chunked_array([b.column(1) for b in held]).combine_chunks().take(pa.array(start))
        done, final = 0, len(start) - 1
        for batch in held:
            at = np.arange(done, done + batch.num_rows)
            of = of_row[at]
            border = {int(start[final]): last, 0: first}
            texts = [None] * len(at)
            for i in border:
                if done <= i < done + len(at):
                    texts[i - done] = border[i]
            columns = [batch.column(0), best.take(pa.array(of)), pa.array(size[of]), pa.array(at == start[of]), batch.column(2), pa.array(of.astype("int64")),
                       pa.array((of == 0) | (of == final)), pa.array(texts, pa.binary())]
            yield as_batch(columns, schema)
            done += len(at)
    return run


def _firsts(text_of, schema: pa.Schema):
    """The first row of every run of a sorted partition of (packed, _sha, ...); `text_of` gives the texts of a batch.

    The newest one is held back until it is known not to be the last.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        last, waiting, number = None, None, 0

        def rows(part: pa.RecordBatch, from_number: int, is_last: bool) -> pa.RecordBatch:
            numbers = np.arange(from_number, from_number + part.num_rows)
            edge = (numbers == 0) | is_last
            border = text_of(part)
            text = pa.array([border[i].as_py() if e else None for i, e in enumerate(edge)], pa.binary())
            return as_batch([*part.columns[:2], pa.array(numbers), pa.array(edge), text], schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            text = text_of(batch)
            found = batch.filter(pa.array(_changes(text, last)))
            last = text[batch.num_rows - 1].as_py()
            if not found.num_rows:
                continue
            if waiting is not None:
                yield rows(waiting, number, False)
                number += 1
            if found.num_rows > 1:
                yield rows(found.slice(0, found.num_rows - 1), number, False)
                number += found.num_rows - 1
            # a copy of one row, so that the batch can go
            waiting = found.take(pa.array([found.num_rows - 1]))
        if waiting is not None:
            yield rows(waiting, number, True)
    return run


def _changes(text: pa.Array, before: bytes | None) -> np.ndarray:
    """True where a text differs from the one before it; whole texts are compared."""
    n = len(text)
    new = np.ones(n, bool)
    new[0] = before is None or text[0].as_py() != before
    new[1:] = pc.not_equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return new


def _sorted(docs: DataFrame, carry: list[str], id_col: str, text_col: str, normal: Column | None, keep: str) -> DataFrame:
    """Rows by content, the one to keep first among equals: the columns `carry` as one, _data, _sha and _id."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    data = F.encode(F.coalesce(normal if normal is not None else F.col(text_col), F.lit("")), "UTF-8")
    wanted = docs.select(packed(carry), data.alias("_data"), F.col(id_col).cast("bigint").alias("_id")).withColumns(
        {"_sha": F.sha2("_data", 256), "_head": F.substring("_data", 1, PREFIX_BYTES)})
    order = ["_head", "_sha", F.asc_nulls_last("_id") if keep == "smallest" else F.desc_nulls_last("_id")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return wanted.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def _chains(found: DataFrame, *sums: str) -> DataFrame:
    """Runs that touch a border, by (_part, _run): `_leads` is true for the first run of equal ones over several partitions.

    At most two rows per partition, without texts, meet in the one task of the windows.
    """
    along = Window.orderBy("_part", "_run")
    edges = found.where("_text IS NOT NULL")
    light = edges.select("_part", "_run", "_sha", *sums)
    before = {"_part0": F.lag("_part").over(along), "_run0": F.lag("_run").over(along), "_sha0": F.lag("_sha").over(along)}
    alike = light.withColumns(before).where(F.col("_sha0") == F.col("_sha")).select("_part", "_run", "_part0", "_run0")
    earlier = edges.select(F.col("_part").alias("_part0"), F.col("_run").alias("_run0"), F.col("_text").alias("_text0"))
    equal = alike.join(edges.select("_part", "_run", "_text"), ["_part", "_run"]).join(earlier, ["_part0", "_run0"]).where(
        F.col("_text") == F.col("_text0")).select("_part", "_run", F.lit(0).alias("_new"))
    chain = light.join(equal, ["_part", "_run"], "left").withColumn("_new", F.coalesce("_new", F.lit(1)))
    chain = chain.withColumn("_chain", F.sum("_new").over(along))
    in_chain = Window.partitionBy("_chain")
    return chain.select("_part", "_run", (F.col("_new") == 1).alias("_leads"),
                        *[F.first(s).over(in_chain.orderBy("_part", "_run")).alias(f"_all{s}") if s == "_best"
                          else F.sum(s).over(in_chain).alias(f"_all{s}") for s in sums])


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal: Column | None = None, keep: str = "smallest",
           carry: tuple[str, ...] | None = None) -> DataFrame:
    """One row per row of `docs`: the columns `carry` (by default the id), keep_id, group_size, kept and text_sha256.

    `normal` is the text to compare, as a column expression; by default the text as it is. `keep` is smallest or largest.
    """
    outputs = [n for n, _ in _OUT]
    names = [c for c in ((id_col,) if carry is None else carry) if c.lower() not in outputs]
    dealt = _sorted(docs, names, id_col, text_col, normal, keep)
    schema = T.StructType([dealt.schema["packed"]] + T._parse_datatype_string(
        f"_best bigint, _size bigint, _pick boolean, {_RUN}").fields)
    found = dealt.select("packed", "_id", "_sha", "_data").mapInArrow(_runs(output_schema(schema)), schema)
    found = staged(found.withColumn("_part", F.spark_partition_id()), run_folder(docs.sparkSession, "exact"), "runs")
    chains = F.broadcast(_chains(found, "_best", "_size"))
    inner = found.where("NOT _edge").select("packed", F.col("_best").alias("keep_id"), F.col("_size").alias("group_size"),
                                            F.col("_pick").alias("kept"), F.col("_sha").alias("text_sha256"))
    outer = found.where("_edge").join(chains, ["_part", "_run"]).select(
        "packed", F.col("_all_best").alias("keep_id"), F.col("_all_size").alias("group_size"),
        (F.col("_pick") & F.col("_leads")).alias("kept"), F.col("_sha").alias("text_sha256"))
    return inner.unionByName(outer).select(*unpacked(names), *outputs)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal: Column | None = None,
                 keep: str = "smallest") -> DataFrame:
    """The rows of `docs` that stay, one of each text."""
    dealt = _sorted(docs, docs.columns, id_col, text_col, normal, keep)
    schema = T.StructType([dealt.schema["packed"]] + T._parse_datatype_string(_RUN).fields)
    if normal is None:
        at, wanted = [c.lower() for c in docs.columns].index(text_col.lower()), dealt.select("packed", "_sha")

        def text_of(batch: pa.RecordBatch) -> pa.Array:
            return batch.column(0).field(at).fill_null("").cast(pa.binary())
    else:
        wanted = dealt.select("packed", "_sha", "_data")

        def text_of(batch: pa.RecordBatch) -> pa.Array:
            return batch.column(2)

    found = wanted.mapInArrow(_firsts(text_of, output_schema(schema)), schema)
    found = staged(found.withColumn("_part", F.spark_partition_id()), run_folder(docs.sparkSession, "exact"), "firsts")
    follows = _chains(found).where("NOT _leads")
    return found.join(F.broadcast(follows), ["_part", "_run"], "left_anti").select("packed.*")
