"""Standardisation, label index, missing classes and scoring vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom import config
from sunloom.functions.numeric import zero_if_bad


def fit_scaler(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row: {mean, std} per column, population std, 0 replaced by 1."""
    def stats(c: str) -> Column:
        x = zero_if_bad(F.col(c))
        std = F.stddev_pop(x)
        return F.struct(F.avg(x).alias("mean"), F.when(std == 0, 1.0).otherwise(std).alias("std")).alias(c)
    return train.agg(F.struct(*[stats(c) for c in columns]).alias("scaler"))


def _z(column: str, value: Column) -> Column:
    return (value - F.col(f"__scaler.{column}.mean")) / F.col(f"__scaler.{column}.std")


def _with(df: DataFrame, scaler: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Read the one-row scaler once, as a column all expressions share."""
    return df.withColumn("__scaler", scaler.scalar()).withColumns(columns).drop("__scaler")


def scaled(df: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores with a fitted scaler; the one-row scaler is read as a scalar, nothing is joined."""
    return _with(df, scaler, {c: _z(c, zero_if_bad(F.col(c))) for c in columns})


def label_index(df: DataFrame, label: str, out: str = "label_index") -> DataFrame:
    """Labels numbered 0.. in sorted order."""
    known = df.select(label).distinct()
    ranks = known.withColumn(out, F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy(label)) - 1)
    return df.join(ranks, label)


def add_missing_classes(df: DataFrame, label: str, features: list[str], classes: int = len(config.CLASS_NAMES)) -> DataFrame:
    """One all-zero row for every class the data lacks."""
    spark = df.sparkSession
    present = df.select(F.col(label).cast("bigint").alias("id")).distinct()
    missing = spark.range(classes).join(present, "id", "left_anti")
    zeros = missing.select(F.col("id").cast(df.schema[label].dataType).alias(label),
                           *[F.lit(0.0).alias(c) for c in features])
    return df.unionByName(zeros, allowMissingColumns=True)


def manual_vector(readings: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """Scaled inputs from the six core readings; every other input sits at its training mean, so it is 0."""
    source = {f: r for r, f in config.READING_TO_FEATURE.items() if r in readings.columns}
    return _with(readings, scaler, {
        c: F.coalesce(_z(c, F.col(source[c]).cast("double")), F.lit(0.0)) if c in source else F.lit(0.0) for c in columns})


def full_vector(features: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """Scaled inputs from a full feature table; absent or NULL features count as raw 0."""
    raw = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in features.columns else F.lit(0.0) for c in columns}
    return _with(features, scaler, {c: _z(c, x) for c, x in raw.items()})
