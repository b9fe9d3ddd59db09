"""Attribution of scores to features: linear models as a projection, trees by path walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_entries(columns: list[str], weights: list[float]) -> Column:
    """{feature, value} entries of one class: coefficient times the scaled input, in column order."""
    return F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) * float(w)).alias("value"))
                     for c, w in zip(columns, weights)])


def nonzero(entries: Column, least: float = 1e-6) -> Column:
    return F.filter(entries, lambda e: F.abs(e["value"]) > least)


def global_importance(df: DataFrame, entries: str = "entries", by: list[str] | None = None) -> DataFrame:
    """Mean |value| per feature over rows and classes."""
    # outer: an inner generator would compute the entries a second time in a filter
    return (df.select(*(by or []), F.inline_outer(entries)).where(F.col("feature").isNotNull()).groupBy(*(by or []), "feature")
            .agg(F.avg(F.abs("value")).alias("importance")))


def top_features(importance: DataFrame, k: int = 5) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(k)
