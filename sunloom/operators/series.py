"""Ordered computations per device that hold when one device owns a large share of all rows.

A plain window puts a whole series into one task. Here the longest series is measured first. Series that fit
a task use the plain window; longer ones are numbered exactly from per-bin counts, cut into slices of a fixed
number of rows, and every slice gets the few neighbouring rows its frames reach. The results are the same.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom import config
from sunloom.session import shared_folder

Step = Callable[[DataFrame, list[str]], DataFrame]
MEASURE = object()  # default of `hot`: measure the series; pass the result of long_series to measure only once


@dataclass
class Long:
    """The series that are too long for a task: their keys and all their rows. Without keys every series of the frame is long."""
    keys: DataFrame | None
    rows: int

    def of(self, df: DataFrame, keys: list[str]) -> DataFrame:
        return df if self.keys is None else df.join(self.keys, keys, "left_semi")

    def others(self, df: DataFrame, keys: list[str]) -> DataFrame:
        return df.join(self.keys, keys, "left_anti")


def long_series(df: DataFrame, keys: list[str], limit: int | None = None) -> Long | None:
    """Series with more than `limit` rows, or None when every series fits one task."""
    limit = limit or config.SERIES_ROWS_PER_TASK
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    rows = sizes.agg(F.sum(F.when(F.col("__rows") > limit, F.col("__rows")))).first()[0]
    return Long(sizes.where(F.col("__rows") > limit).select(*keys), rows) if rows else None


def dealt(sliced: DataFrame, keys: list[str], rows: int, limit: int) -> DataFrame:
    """Slices dealt to as many partitions as there are slices. With a given number of partitions Spark does not merge them into
    one per core, so the rows that a task sorts do not grow with the table."""
    return sliced.repartition(math.ceil(rows / limit), *keys, "__slice")


def numbered_by(df: DataFrame, keys: list[str], bin_of: Column, order: list, out: str) -> DataFrame:
    """Exact 0-based position when `bin_of` grows with `order`: counts of earlier bins plus the place in the bin."""
    binned = df.withColumn("__bin", bin_of)
    counts = binned.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__bin", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__bin").orderBy(*order)
    local = binned.withColumn("__local", F.row_number().over(inside) - 1)
    return (local.join(offsets, [*keys, "__bin"])
            .withColumn(out, F.col("__before") + F.col("__local")).drop("__bin", "__local", "__before"))


def numbered(df: DataFrame, keys: list[str], ts: str, tie: str, out: str = "pos",
             bin_seconds: int | None = None) -> DataFrame:
    """Exact 0-based position by (ts, tie) without putting a series, or the whole table, into one task.

    Rows are numbered inside short time bins; the counts of earlier bins, a small table, give the offset.
    """
    width = (bin_seconds or config.POSITION_BIN_SECONDS) * 1_000_000
    return numbered_by(df, keys, F.floor(F.unix_micros(ts) / F.lit(width)), [ts, tie], out)


def ranged(df: DataFrame, order: list, name: str) -> DataFrame:
    """`df` dealt into sampled ranges of `order`, stored, with the number of the range in `__part`.

    Ranges hold about equal numbers of rows wherever the values crowd. The table is stored because ranges are sampled anew
    each time a plan runs.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def chained(df: DataFrame, keys: list[str], chain: Callable[[DataFrame, object], DataFrame], limit: int | None = None,
            hot=MEASURE) -> DataFrame:
    """Run several steps with one split: `chain(frame, hot)` sees the short series, then the long ones.

    Splitting inside every step instead would double the plan with each step.
    """
    hot = long_series(df, keys, limit) if hot is MEASURE else hot
    if hot is None or hot.keys is None:
        return chain(df, hot)
    return chain(hot.others(df, keys), None).unionByName(chain(hot.of(df, keys), Long(None, hot.rows)))


def positions(df: DataFrame, keys: list[str], ts: str, tie: str, out: str = "pos",
              limit: int | None = None, hot=MEASURE) -> DataFrame:
    """0-based position in each series; the plain window while every series fits a task."""
    def plain(frame: DataFrame) -> DataFrame:
        return frame.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(ts, tie)) - 1)

    hot = long_series(df, keys, limit) if hot is MEASURE else hot
    if hot is None:
        return plain(df)
    placed = numbered(hot.of(df, keys), keys, ts, tie, out)
    return placed if hot.keys is None else plain(hot.others(df, keys)).unionByName(placed)


def over_series(df: DataFrame, keys: list[str], ts: str, tie: str, step: Step, behind: int = 0, ahead: int = 0,
                limit: int | None = None, hot=MEASURE) -> DataFrame:
    """Apply `step(frame, partition_columns)`, whose frames reach `behind` rows back and `ahead` rows forward."""
    limit = limit or config.SERIES_ROWS_PER_TASK
    if max(behind, ahead) > limit:
        raise ValueError("frames must not be wider than a slice")
    hot = long_series(df, keys, limit) if hot is MEASURE else hot
    if hot is None:
        return step(df, keys)
    big = numbered(hot.of(df, keys), keys, ts, tie, "__pos")
    home = F.floor(F.col("__pos") / F.lit(limit))
    inside = F.col("__pos") % F.lit(limit)
    copies = F.array_compact(F.array(
        home, F.when(inside >= limit - behind, home + 1), F.when((inside < ahead) & (home > 0), home - 1)))
    sliced = big.withColumn("__home", home).withColumn("__slice", F.explode(copies))
    done = (step(dealt(sliced, keys, hot.rows, limit), [*keys, "__slice"]).where(F.col("__home") == F.col("__slice"))
            .drop("__pos", "__home", "__slice"))
    return done if hot.keys is None else step(hot.others(df, keys), keys).unionByName(done)


def fill_forward(df: DataFrame, keys: list[str], ts: str, tie: str, columns: dict[str, Column] | list[str],
                 limit: int | None = None, hot=MEASURE) -> DataFrame:
    """Last non-NULL value so far for each column; leading NULLs stay.

    `columns` maps an output name to the expression to fill; a list fills columns in place. Long series
    are filled per slice, then take the last value of the earlier slices from a small per-slice table.
    """
    limit = limit or config.SERIES_ROWS_PER_TASK
    columns = columns if isinstance(columns, dict) else {c: F.col(c) for c in columns}
    sofar = (Window.unboundedPreceding, 0)

    def plain(frame: DataFrame) -> DataFrame:
        series = Window.partitionBy(*keys).orderBy(ts, tie).rowsBetween(*sofar)
        return frame.withColumns({n: F.last(c, True).over(series) for n, c in columns.items()})

    hot = long_series(df, keys, limit) if hot is MEASURE else hot
    if hot is None:
        return plain(df)
    big = (numbered(hot.of(df, keys), keys, ts, tie, "__pos")
           .withColumn("__slice", F.floor(F.col("__pos") / F.lit(limit)))
           .withColumns({f"__v_{n}": c for n, c in columns.items()}))
    slices = big.groupBy(*keys, "__slice").agg(*[
        F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col("__pos"))).alias(f"__v_{n}")
        for n in columns])
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(*keys, "__slice", *[F.last(f"__v_{n}", True).over(earlier).alias(f"__c_{n}")
                                                for n in columns])
    inside = Window.partitionBy(*keys, "__slice").orderBy("__pos").rowsBetween(*sofar)
    filled = (dealt(big, keys, hot.rows, limit).withColumns({f"__v_{n}": F.last(f"__v_{n}", True).over(inside) for n in columns})
              .join(carried, [*keys, "__slice"])
              .withColumns({n: F.coalesce(f"__v_{n}", f"__c_{n}") for n in columns}))
    extra = [f"__v_{n}" for n in columns] + [f"__c_{n}" for n in columns]
    filled = filled.drop("__pos", "__slice", *extra)
    return filled if hot.keys is None else plain(hot.others(df, keys)).unionByName(filled)


def latest(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """One newest row per key as an aggregation: one row per key and task is shuffled. Spark sorts rows by key for it."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("__row")
    return df.groupBy(*keys).agg(newest).select(*keys, "__row.*")


def latest_with_ties(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Every row that carries its key's newest timestamp."""
    newest = df.groupBy(*keys).agg(F.max(ts).alias(ts))
    return df.join(newest, [*keys, ts], "left_semi")


def keep_last(df: DataFrame, keys: list[str], ts: str, n: int, out: str = "rank", tie: str | None = None) -> DataFrame:
    """The newest n rows per key, equal times by `tie`; Spark trims each partition to n rows per key before the shuffle."""
    series = Window.partitionBy(*keys).orderBy(F.desc(ts), *([F.desc(tie)] if tie else []))
    return df.withColumn(out, F.row_number().over(series)).where(F.col(out) <= n)


def thin_out(df: DataFrame, keys: list[str], ts: str, tie: str, points: int = 300,
             limit: int | None = None) -> DataFrame:
    """At most `points` evenly spaced rows per series: row i stays when i is a multiple of ceil(n / points)."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    placed = positions(df, keys, ts, tie, "pos", limit).join(sizes, keys)
    return placed.where(F.col("pos") % F.ceil(F.col("n_rows") / F.lit(points)) == 0)
