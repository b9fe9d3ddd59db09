"""Whole-table order: chronological position, splits and walk-forward folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom import config
from sunloom.operators import series


def chronological(df: DataFrame, ts: str, tie: str, out: str = "pos") -> DataFrame:
    """0-based position in time over the whole table; no task sees the whole table.

    Rows are dealt into ranges of (ts, tie), so that a busy hour, or one time stamp that many rows share, fills several
    ranges. Rows are numbered inside their range; the counts of earlier ranges, one row each, give the offset.
    """
    return series.numbered_by(series.ranged(df, [ts, tie], "order"), [], F.col("__part"), [ts, tie], out).drop("__part")


def train_rows(n: int, test_share: float = config.TEST_SHARE) -> int:
    return int(n * (1 - test_share))


def folds(n_train: int, k: int = config.FOLDS, balanced: bool = False) -> list[tuple[int, int, int]]:
    """(train end, validation start, validation end) of each expanding fold; empty validations are left out.

    With the default rule the last validation holds only the remainder of n_train / (k + 1). `balanced`
    spreads the rows over k + 1 parts so that every validation has about the same size.
    """
    if balanced:
        cuts = [n_train * (i + 1) // (k + 1) for i in range(k + 1)]
        return [(a, a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
    size = n_train // (k + 1)
    ends = [(size * (i + 2), min(size * (i + 3), n_train)) for i in range(k)]
    return [(end, end, stop) for end, stop in ends if stop > end]


def split_column(pos: Column, n: int, test_share: float = config.TEST_SHARE) -> Column:
    return F.when(pos < train_rows(n, test_share), "train").otherwise("test")


def fold_parts(pos: Column, n_train: int, k: int = config.FOLDS, balanced: bool = False) -> Column:
    """ARRAY of {fold, part} memberships of a row; explode it to get one row per fold."""
    parts = []
    for i, (end, start, stop) in enumerate(folds(n_train, k, balanced), 1):
        part = F.when(pos < end, "train").when((pos >= start) & (pos < stop), "val")
        parts.append(F.when(part.isNotNull(), F.struct(F.lit(i).alias("fold"), part.alias("part"))))
    return F.array_compact(F.array(*parts))


#: Rows among which the wanted one is taken by one task.
LAST_ROWS = 100_000


def row_at(df: DataFrame, ts: str, tie: str, at: int) -> tuple | None:
    """(ts, tie) of the row at place `at` (from 0) in the order of both; None where there are fewer rows.

    No sort of the table: approximate quantiles and a count narrow the rows down to at most `LAST_ROWS`, first by time, then,
    if more share one instant, by tie. Each round leaves less than a thousandth.
    """
    rows = df.select(F.unix_micros(ts).alias("__t"), F.col(tie).cast("bigint").alias("__i"))
    left, before = rows.count(), 0
    if not 0 <= at < left:
        return None
    key = "__t"
    while left > LAST_ROWS:
        p, near = (at - before) / left, 2.0 / 10_000
        edges = rows.agg(F.percentile_approx(key, [max(p - near, 0.0), min(p + near, 1.0)], 10_000)).first()[0]
        low = None if p <= near else edges[0]
        high = None if p >= 1 - near else edges[1]
        under = 0 if low is None else rows.where(F.col(key) < low).count()
        inside = rows if low is None else rows.where(F.col(key) >= low)
        inside = inside if high is None else inside.where(F.col(key) <= high)
        count = inside.count()
        if not before + under <= at < before + under + count:
            raise RuntimeError("approximate quantiles missed the row")
        if low is not None and low == high and key == "__t":
            key = "__i"
        elif count == left:
            break
        rows, before, left = inside, before + under, count
    found = rows.orderBy("__t", "__i").offset(at - before).limit(1).select(F.timestamp_micros("__t").alias("t"), "__i").first()
    return found["t"], found["__i"]


def earlier(ts: str, tie: str, cut: tuple | None) -> Column:
    """Whether a row comes before the row `cut` in the order of (ts, tie); all do without one."""
    if cut is None:
        return F.lit(True)
    when, number = F.lit(cut[0]), F.lit(cut[1])
    return (F.col(ts) < when) | ((F.col(ts) == when) & (F.col(tie) < number))
