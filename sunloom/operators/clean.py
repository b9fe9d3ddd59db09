"""Cleaning of long telemetry: times, duplicates, fills, clipping, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom import config
from sunloom.functions.timeparts import from_epoch_ms
from sunloom.operators import quantiles, series

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def numeric_columns(df: DataFrame, skip: list[str] = ()) -> list[str]:
    return [n for n, t in df.dtypes if (t in NUMERIC or t.startswith("decimal")) and n not in skip]


def feature_columns(df: DataFrame) -> list[str]:
    """Model inputs: numeric columns that are neither keys, label nor metadata, by name."""
    return sorted(numeric_columns(df, config.NOT_FEATURES))


def parse_times(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Epoch milliseconds to timestamps; rows without one or outside the sane range go."""
    low, high = config.SANE_RANGE
    return df.withColumn(column, from_epoch_ms(F.col(column))).where(F.col(column).between(
        F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp")))


def winsorise(df: DataFrame, columns: list[str] | None = None, factor: float = config.IQR_FACTOR,
              fit_on: DataFrame | None = None, exclude: list[str] = (), exact: bool = True) -> DataFrame:
    """Clip to [q1 - factor IQR, q3 + factor IQR]; NULLs stay, columns with IQR 0 are untouched."""
    columns = [c for c in columns or numeric_columns(df, config.NOT_CLIPPED) if c not in exclude]
    if not columns:
        return df
    bounds = quantiles.iqr_bounds(df if fit_on is None else fit_on, columns, factor, exact)
    # one row with every bound, read by each task as a scalar
    row = bounds.agg(*[F.max(F.when(F.col("column") == c, F.struct("low", "high"))).alias(c) for c in columns])
    limits = row.select(F.struct("*").alias("limits")).scalar()

    def clipped(c: str) -> Column:
        low, high = F.col(f"__limits.{c}.low"), F.col(f"__limits.{c}.high")
        value = F.col(c).cast("double")
        return F.when(low.isNull() | value.isNull(), value).otherwise(F.least(F.greatest(value, low), high))

    return df.withColumn("__limits", limits).withColumns({c: clipped(c) for c in columns}).drop("__limits")


def clean(df: DataFrame, keys: list[str] | None = None, limit: int | None = None, exact: bool = True) -> DataFrame:
    """The whole cleaning stage on ingested telemetry; adds `row_id`, a stable order for equal times."""
    keys = keys or [k for k in config.SERIES_KEYS if k in df.columns]
    unique = parse_times(df).dropna(subset=keys).dropDuplicates()
    unique = unique.withColumn("row_id", F.xxhash64(*[f"`{c}`" for c in sorted(unique.columns)]))
    slow = [c for c in config.SLOW_COLUMNS if c in unique.columns]
    filled = series.fill_forward(unique, keys, "timestamp", "row_id", slow, limit) if slow else unique
    clipped = winsorise(filled, numeric_columns(filled, [*config.NOT_CLIPPED, "row_id"]), exact=exact)
    kept = clipped.drop(*config.DROPPED_COLUMNS)
    return kept.fillna(0, subset=numeric_columns(kept, ["row_id"]))


def broken_rules(reading: dict[str, Column]) -> Column:
    """Names of the range rules a reading breaks, in rule order."""
    checks = []
    for name, (low, high) in config.READING_RANGES.items():
        if name in reading:
            value = reading[name].cast("double")
            checks.append(F.when(value.isNotNull() & ~value.between(low, high), F.lit(name)))
    return F.array_compact(F.array(*checks))


def split_valid(df: DataFrame, reading: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows inside all ranges, and the others with the rules they break."""
    checked = df.withColumn("broken", broken_rules(reading))
    return checked.where(F.size("broken") == 0).drop("broken"), checked.where(F.size("broken") > 0)


def numeric_features(features: Column) -> Column:
    """MAP of text to MAP of doubles, unreadable values dropped."""
    return F.map_filter(F.transform_values(features, lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull())


def allowed_features(weights: Column, extra: list[str] = ()) -> Column:
    """Map entries whose name starts with a known prefix or is listed in `extra`."""
    def known(name: Column) -> Column:
        hit = name.isin(list(extra)) if extra else F.lit(False)
        for prefix in config.FEATURE_PREFIXES:
            hit = hit | name.startswith(prefix)
        return hit
    return F.map_filter(weights, lambda k, v: known(k))


__all__ = ["allowed_features", "broken_rules", "clean", "feature_columns", "numeric_columns",
           "numeric_features", "parse_times", "split_valid", "winsorise"]
