"""Raw plant exports: wide CSV files per plant folder to one long table."""

from __future__ import annotations

import csv
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom import config

DEVICE_COLUMN = re.compile(r"inverters\[(\d+)\]\.(.+)")


def device_columns(columns: list[str]) -> dict[int, dict[str, str]]:
    """{device index: {field: column}} for names like `inverters[2].power`."""
    found: dict[int, dict[str, str]] = {}
    for column in columns:
        match = DEVICE_COLUMN.fullmatch(column)
        if match:
            found.setdefault(int(match[1]), {})[match[2]] = column
    return found


def shared_names(columns: list[str]) -> dict[str, str]:
    """{short name: column} of the columns all devices share; the first of two equal short names stays."""
    plan: dict[str, str] = {}
    for column in columns:
        if not DEVICE_COLUMN.fullmatch(column):
            prefix = next((p for p in config.SHARED_PREFIXES if column.startswith(p)), "")
            plan.setdefault(column.removeprefix(prefix), column)
    return plan


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def melt(wide: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per device and time stamp, device numbers from 1, fields a device lacks as NULL.

    One pass: every wide row becomes an array with one struct per device.
    """
    devices = device_columns(wide.columns)
    types = {f.name: f.dataType for f in wide.schema.fields}
    fields: dict[str, object] = {}
    for mapping in devices.values():
        for field, column in mapping.items():
            fields.setdefault(field, types[column])
    shared = {n: c for n, c in shared_names(wide.columns).items() if n not in fields and n not in (keep or [])}

    def one(index: int, mapping: dict[str, str]) -> Column:
        cells = [(quoted(mapping[f]) if f in mapping else F.lit(None)).cast(t).alias(f) for f, t in fields.items()]
        return F.struct(F.lit(index + 1).alias("inverter_id"), *cells)

    rows = F.explode(F.array(*[one(i, m) for i, m in sorted(devices.items())])).alias("device")
    return wide.select(*[quoted(c) for c in keep or []], *[quoted(c).alias(n) for n, c in shared.items()],
                       rows).select("*", "device.*").drop("device")


def numeric_text(df: DataFrame, always: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """Text columns become DOUBLE when more than half of their values read as numbers; one scan decides for all."""
    text = [n for n, t in df.dtypes if t == "string"]
    if not text:
        return df
    shares = numeric_shares(df, text).first()
    chosen = [c for c in text if c in always or shares[c]["converted"] > shares[c]["present"] * 0.5]
    return df.withColumns({c: quoted(c).try_cast("double") for c in chosen})


def numeric_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: per column how many values are present and how many read as numbers."""
    return df.agg(*[F.struct(F.count(quoted(c)).alias("present"),
                             F.count(quoted(c).try_cast("double")).alias("converted")).alias(c) for c in columns])


def plant_files(spark: SparkSession, root: str) -> list[str]:
    """CSV files below the `Plant *` folders, listed by Spark without reading their content."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(f"{root.rstrip('/')}/Plant */")
    return sorted(r.path for r in listing.select("path").collect())


def headers(spark: SparkSession, files: list[str]) -> dict[str, tuple[str, ...]]:
    """The column names of each file: one job reads the first block of every file and keeps its first line."""
    lines = spark.read.text(files).select("value", F.monotonically_increasing_id().alias("at"), "_metadata.file_path", "_metadata.file_block_start")
    first = lines.where(F.col("file_block_start") == 0).groupBy("file_path").agg(F.min_by("value", "at").alias("line"))
    return {unquote(r.file_path): tuple(next(csv.reader([r.line.lstrip("\ufeff")]))) for r in first.sort("file_path").collect()}


def in_sample(key: list[Column], share: float, seed: int) -> Column:
    """True for about `share` of all keys: a hash decides, so reruns and other file splits give the same rows."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key])), 1, 8)
    return digits < F.lit(f"{int(share * 2**32):08x}")


def ingest(spark: SparkSession, root: str, share: float = 1.0, seed: int = config.SEED) -> DataFrame:
    """All plant files as one long table; files with equal headers are read together.

    Only header lines reach the driver. `share` keeps a seeded sample of the wide rows for trial runs.
    """
    files = plant_files(spark, root)
    if not files:
        raise FileNotFoundError(f"no 'Plant *' folder with CSV files under {root}")

    groups: dict[tuple[str, ...], list[str]] = {}
    for path, names in headers(spark, files).items():
        groups.setdefault(names, []).append(path)
    frames = []
    for names, paths in groups.items():
        schema = ", ".join(f"`{n}` string" for n in names)
        wide = spark.read.schema(schema).option("header", True).csv(paths)
        folder = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"/(Plant [^/]*)/[^/]+$", 1)
        wide = wide.select("*", folder.alias("plant_id"))
        if 0 < share < 1:
            wide = wide.where(in_sample([F.col("plant_id"), *map(quoted, names)], share, seed))
        frames.append(melt(wide, keep=["plant_id"]))
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame, allowMissingColumns=True)
    return numeric_text(union)
