"""Helpers the operators share: intermediate tables, word rules and hashes on bytes."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sunloom.session import shared_folder

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z and blanks every ASCII byte that is neither a letter nor a digit; bytes of other characters stay.
ALNUM_WORDS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in _LOWER)
#: Lower-cases A-Z; white space is 09-0D and 20, as `bytes.split` has it.
SPACED_WORDS = _LOWER

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{folder.rstrip('/')}/documents.parquet")


def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("item_id bigint, text string").parquet(f"{folder.rstrip('/')}/benchmark.parquet")


def run_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder below the shared one, for the tables of one call."""
    return f"{shared_folder(spark).rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write `df` below `folder` and read it back: cuts the lineage, and survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_words(text: str | None, table: bytes) -> list[bytes]:
    return text.encode().translate(table).split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def replacing(df: DataFrame, outputs: list[tuple[str, str]], *reads: str) -> tuple[DataFrame, T.StructType]:
    """`df` without the columns that are named like an output, and its schema with the outputs (names and types) behind.

    A column that the operator reads can't be one that it writes.
    """
    names = {n.lower() for n, _ in outputs}
    if names & {r.lower() for r in reads}:
        raise ValueError(f"an output can't have the name of an input: {sorted(names)}")
    kept = df.drop(*[c for c in df.columns if c.lower() in names])
    return kept, T.StructType(kept.schema.fields + [T.StructField(n, T._parse_datatype_string(t)) for n, t in outputs])


def fresh(columns: list[str], name: str) -> str:
    """`name`, or a name made from it that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(columns: list[str]) -> Column:
    """All columns as one, so that no name of a caller meets one of an operator; `packed.*` unpacks them."""
    return (F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(0).alias("none"))).alias("packed")


def unpacked(columns: list[str]) -> list[str]:
    return ["packed.*"] if columns else []


def output_schema(schema: T.StructType) -> pa.Schema:
    """The Arrow schema Spark expects back for `schema`."""
    return to_arrow_schema(schema)


def with_arrays(batch: pa.RecordBatch, schema: pa.Schema, arrays: list) -> pa.RecordBatch:
    """`batch` plus further columns, under the Arrow schema of the output."""
    extra = [pa.array(a, schema.field(i + batch.num_columns).type) if not isinstance(a, pa.Array) else a for i, a in enumerate(arrays)]
    return as_batch([*batch.columns, *extra], schema)


def as_batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of `columns` in the types of `schema`."""
    typed = [c if c.type == schema.field(i).type else c.cast(schema.field(i).type) for i, c in enumerate(columns)]
    return pa.RecordBatch.from_arrays(typed, schema=schema)


#: Objects that a worker process keeps at a time; workers outlive tasks and stages.
KEPT_OBJECTS = 2
_LOADED: dict[tuple, object] = {}


def forget(most: int = 0) -> None:
    """Drop the objects that this worker keeps, all but the newest `most`, and give their memory back to the system.

    For tasks that need none of them: idle workers may outlive the stage that filled them.
    """
    if len(_LOADED) <= most:
        return
    while len(_LOADED) > most:
        del _LOADED[next(iter(_LOADED))]
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def once(key: tuple, make):
    """One object per worker process and key, of the keys used last."""
    if key not in _LOADED:
        forget(KEPT_OBJECTS - 1)
        _LOADED[key] = make()
    _LOADED[key] = _LOADED.pop(key)
    return _LOADED[key]


def slices(batch: pa.RecordBatch, at: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """`batch` in runs of rows whose column `at` has about `most` bytes, so that long texts are not copied all at once."""
    rows = batch.num_rows
    if batch.column(at).nbytes <= most or rows < 2:
        if rows:
            yield batch
        return
    yield from slices(batch.slice(0, rows // 2), at, most)
    yield from slices(batch.slice(rows // 2), at, most)
