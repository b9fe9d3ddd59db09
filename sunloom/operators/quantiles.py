"""Exact order statistics without collecting a column into one task.

Approximate quantiles bracket each wanted rank. Values below a bracket are only counted, values inside are counted
per distinct value before the shuffle, the rest never moves; hot values shrink to one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom.operators import series

ACCURACY = 10_000


def _long(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*by, F.inline(cells)).where(F.col("value").isNotNull() & ~F.isnan("value"))


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], by: list[str] | None = None,
                    method: str = "linear", accuracy: int = ACCURACY) -> DataFrame:
    """Rows (by..., column, p, value). `linear` interpolates between ranks; `nearest` takes sorted[floor(n * p)].

    Groups with a NULL in `by` are left out.
    """
    by = by or []
    keys = [*by, "column"]
    long = _long(df, columns, by)
    near, wide = 2.0 / accuracy, 0.05
    reach = [q for p in probabilities for d in (near, wide) for q in (max(p - d, 0.0), min(p + d, 1.0))]
    sketch = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.percentile_approx("value", reach, accuracy).alias("q"))
    slots = F.array(*[F.struct(F.lit(p).alias("p"), F.slice("q", 4 * i + 1, 4).alias("b"))
                      for i, p in enumerate(probabilities)])
    last = F.col("n") - 1
    rank = F.col("n") * F.col("p") if method == "nearest" else last * F.col("p")
    # A bracket must hold the wanted rank and the one after it: widen it when few rows fall inside.
    dense, some = F.col("n") >= 2 * accuracy, F.col("n") >= 100

    def edge(i: int, end: str, open_end: Column) -> Column:
        tight = F.when(dense, F.get("b", F.lit(i))).when(some, F.get("b", F.lit(i + 2)))
        return F.when(open_end, F.col(end)).otherwise(F.coalesce(tight, F.col(end)))

    wanted = sketch.dropna(subset=keys).select(*keys, "n", "least", "most", F.inline(slots)).select(
        *keys, "p", F.least(F.floor(rank), last).alias("rank"), (rank - F.floor(rank)).alias("part"),
        edge(0, "least", F.col("p") <= near).alias("low"), edge(1, "most", F.col("p") >= 1 - near).alias("high"))
    # Without groups there is one row per column and probability, whatever the data: safe to broadcast.
    bound = long.join(wanted if by else F.broadcast(wanted), keys).where(F.col("value") <= F.col("high"))
    # All values below a bracket merge into one, so only distinct values inside brackets are shuffled.
    slot = [*keys, "p"]
    merged = F.when(F.col("value") < F.col("low"), float("-inf")).otherwise(F.col("value"))
    counted = (bound.withColumn("value", merged).groupBy(*slot, "rank", "part", "value")
               .agg(F.count(F.lit(1)).alias("c")))
    # The values of a bracket are dealt into sampled ranges: positions inside a range, plus the counts of earlier ranges.
    dealt = series.ranged(counted, [*slot, "value"], "quantiles")
    along = Window.partitionBy(*slot).orderBy("__part")
    ranges = dealt.groupBy(*slot, "__part").agg(F.sum("c").alias("__n"), F.min("value").alias("__first")).select(
        *slot, "__part", F.coalesce(F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.lead("__first").over(along).alias("__then"))
    running = Window.partitionBy(*slot, "__part").orderBy("value")
    inside = (dealt.withColumns({"__sum": F.sum("c").over(running.rowsBetween(Window.unboundedPreceding, 0)),
                                 "__lead": F.lead("value").over(running)}).join(ranges, [*slot, "__part"])
              .withColumns({"to": F.col("__before") + F.col("__sum"), "next": F.coalesce("__lead", "__then")})
              .withColumn("from", F.col("to") - F.col("c")))
    hit = inside.where((F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to")))
    if method == "nearest":
        found = hit.select(*slot, "value")
    else:
        following = F.when(F.col("rank") + 1 < F.col("to"), F.col("value")).otherwise(F.coalesce(F.col("next"), F.col("value")))
        found = hit.select(*slot, (F.col("value") + (following - F.col("value")) * F.col("part")).alias("value"))
    missed = F.raise_error(F.lit("a quantile bracket missed its rank"))
    return wanted.select(*slot).join(found, slot, "left").withColumn("value", F.when(F.col("value").isNull(), missed).otherwise(F.col("value")))


def approximate_quantiles(df: DataFrame, columns: list[str], probabilities: list[float],
                          accuracy: int = ACCURACY) -> DataFrame:
    """The one-pass option: same shape as `exact_quantiles`, rank error up to 1/accuracy."""
    long = _long(df, columns, [])
    return long.groupBy("column").agg(F.percentile_approx("value", probabilities, accuracy).alias("v")).select(
        "column", F.inline(F.arrays_zip(F.array(*[F.lit(p) for p in probabilities]).alias("p"), F.col("v").alias("value"))))


def iqr_bounds(df: DataFrame, columns: list[str], factor: float, exact: bool = True) -> DataFrame:
    """Rows (column, q1, q3, low, high); columns whose IQR is 0 get NULL bounds."""
    q = exact_quantiles(df, columns, [0.25, 0.75]) if exact else approximate_quantiles(df, columns, [0.25, 0.75])
    pair = q.groupBy("column").agg(F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q1"),
                                   F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q3"))
    gap: Column = F.col("q3") - F.col("q1")
    real = gap != 0
    return pair.select("column", "q1", "q3", F.when(real, F.col("q1") - gap * factor).alias("low"),
                       F.when(real, F.col("q3") + gap * factor).alias("high"))
