"""Rounding, guarded arithmetic and null rules that differ between the systems being matched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def js_round(value: Column, places: int = 0) -> Column:
    """Halves go towards plus infinity (browser `Math.round`), scaled for decimals."""
    scale = float(10 ** places)
    return F.floor(value * scale + F.lit(0.5)) / F.lit(scale)


def even_round(value: Column, places: int = 0) -> Column:
    """Halves go to the even neighbour (Python `round`)."""
    return F.bround(value, places)


def strict_greatest(*columns: Column) -> Column:
    """MySQL GREATEST: NULL as soon as one argument is NULL."""
    return F.when(reduce(lambda a, b: a | b, [c.isNull() for c in columns]), None).otherwise(F.greatest(*columns))


def strict_least(*columns: Column) -> Column:
    """MySQL LEAST: NULL as soon as one argument is NULL."""
    return F.when(reduce(lambda a, b: a | b, [c.isNull() for c in columns]), None).otherwise(F.least(*columns))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def ratio(top: Column, bottom: Column) -> Column:
    """NULL instead of an ANSI error when the denominator is 0."""
    return F.try_divide(top, bottom)


def zero_if_bad(value: Column) -> Column:
    """NULL, NaN and both infinities become 0."""
    value = value.cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(value)


def flag(condition: Column) -> Column:
    """1 / 0 with NULL conditions counted as 0."""
    return F.when(condition, 1).otherwise(0)


def column_or(df: DataFrame, name: str, default) -> Column:
    """The column when the frame has it, else a constant."""
    return F.col(name) if name in df.columns else F.lit(default)
