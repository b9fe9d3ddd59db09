"""Per-device features: rolling statistics, lags, streaks, deltas, KPIs and time encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom import config
from sunloom.functions.numeric import column_or
from sunloom.functions.timeparts import time_encodings
from sunloom.operators import series

# Frames at least this wide are assembled from block halves instead of being re-read for every row.
WIDE_FRAME = 48


def _narrow_stats(df: DataFrame, part: list[str], order: list[str], signals: list[str], label: str, rows: int,
                  extremes: bool) -> DataFrame:
    frame = Window.partitionBy(*part).orderBy(*order).rowsBetween(1 - rows, 0)
    added: dict[str, Column] = {}
    for s in signals:
        added[f"{s}_rmean_{label}"] = F.avg(s).over(frame)
        added[f"{s}_rstd_{label}"] = F.coalesce(F.stddev_samp(s).over(frame), F.lit(0.0))
        if extremes:
            added[f"{s}_rmin_{label}"] = F.min(s).over(frame)
            added[f"{s}_rmax_{label}"] = F.max(s).over(frame)
    return df.withColumns(added)


def _wide_stats(df: DataFrame, part: list[str], order: list[str], signals: list[str], label: str, rows: int,
                extremes: bool) -> DataFrame:
    """Moving statistics with work per row that does not grow with the frame (block halves, van Herk 1992).

    The series is cut into blocks of `rows` rows. A frame is the tail of one block plus the head of the next,
    so running statistics forwards and backwards inside the blocks are enough. Means and variances merge by
    Chan's formula, which never subtracts large sums.
    """
    row = F.col("__rn")
    whole = Window.partitionBy(*part).orderBy(*order)
    blocks = df.withColumn("__rn", F.row_number().over(whole) - 1).withColumn("__block", F.floor(row / F.lit(rows)))
    grow = (Window.unboundedPreceding, 0)
    head = Window.partitionBy(*part, "__block").orderBy("__rn").rowsBetween(*grow)
    tail = Window.partitionBy(*part, "__block").orderBy(F.desc("__rn")).rowsBetween(*grow)

    def halves(s: str, window) -> list[Column]:
        stats = [F.count(s).over(window).alias("n"), F.avg(s).over(window).alias("m"),
                 F.var_pop(s).over(window).alias("v")]
        if extremes:
            stats += [F.min(s).over(window).alias("lo"), F.max(s).over(window).alias("hi")]
        return stats

    for name, window in (("h", head), ("t", tail)):
        blocks = blocks.withColumns({f"__{name}_{s}": F.struct(*halves(s, window)) for s in signals})
    # The tail that starts rows-1 back; a frame that is exactly one block has no tail.
    crossing = row % F.lit(rows) != rows - 1
    blocks = blocks.withColumns({f"__t_{s}": F.when(crossing, F.lag(f"__t_{s}", rows - 1).over(whole))
                                 for s in signals})
    added: dict[str, Column] = {}
    for s in signals:
        h, t = F.col(f"__h_{s}"), F.col(f"__t_{s}")
        hn, tn = h["n"].cast("double"), F.coalesce(t["n"], F.lit(0)).cast("double")
        n = hn + tn
        hm, tm = F.coalesce(h["m"], F.lit(0.0)), F.coalesce(t["m"], F.lit(0.0))
        gap = tm - hm
        mean = F.try_divide(hm * hn + tm * tn, n)
        squares = (F.coalesce(h["v"], F.lit(0.0)) * hn + F.coalesce(t["v"], F.lit(0.0)) * tn
                   + F.coalesce(F.try_divide(gap * gap * hn * tn, n), F.lit(0.0)))
        added[f"{s}_rmean_{label}"] = mean
        added[f"{s}_rstd_{label}"] = F.when(n > 1, F.sqrt(squares / (n - 1))).otherwise(0.0)
        if extremes:
            added[f"{s}_rmin_{label}"] = F.least(h["lo"], t["lo"])
            added[f"{s}_rmax_{label}"] = F.greatest(h["hi"], t["hi"])
    helpers = ["__rn", "__block"] + [f"__{p}_{s}" for p in "ht" for s in signals]
    return blocks.withColumns(added).drop(*helpers)


def rolling(df: DataFrame, part: list[str], order: list[str], signals: list[str] | None = None,
            frames: dict[str, int] | None = None, extremes: str | None = "24h",
            wide: int | None = None) -> DataFrame:
    """Rolling mean and sample std for every frame, min and max for the frame named `extremes`.

    Frames count rows and may be partial at the start of a series; a single row has std 0.
    """
    frames = frames or config.FRAMES
    wide = WIDE_FRAME if wide is None else wide
    present = [s for s in signals or config.ROLLING_SIGNALS if s in df.columns]
    for label, rows in frames.items():
        stats = _wide_stats if rows >= wide else _narrow_stats
        df = stats(df, part, order, present, label, rows, label == extremes)
    return df


def string_imbalance(df: DataFrame) -> Column:
    """Largest minus smallest string current of the row, NULLs ignored."""
    present = [F.col(c) for c in config.STRING_CURRENTS if c in df.columns]
    if not present:
        return F.lit(0.0)
    return F.lit(0.0) if len(present) == 1 else F.greatest(*present) - F.least(*present)


def row_kpis(df: DataFrame, frame: str = "24h") -> dict[str, Column]:
    """KPIs that need only the row and its rolling statistics."""
    mean, std = column_or(df, f"power_rmean_{frame}", 0.0), column_or(df, f"power_rstd_{frame}", 0.0)
    volts = {"pv1_voltage", "v_r"} <= set(df.columns)
    powers = [F.coalesce(F.col(c), F.lit(0.0)) for c in config.STRING_POWERS if c in df.columns]
    return {
        "power_variability": F.when(mean > 0, std / mean).otherwise(0.0),
        "string_imbalance": string_imbalance(df),
        "voltage_deviation": F.abs(F.col("pv1_voltage") - F.col("v_r")) if volts else F.lit(0.0),
        "total_pv_power": sum(powers[1:], powers[0]) if powers else column_or(df, "power", 0.0),
    }


def counter_step(part: list[str], order: list[str], counter: str = "kwh_total") -> Column:
    """Growth since the previous sample, never negative, 0 on the first."""
    before = F.lag(counter).over(Window.partitionBy(*part).orderBy(*order))
    return F.greatest(F.coalesce(F.col(counter) - before, F.lit(0.0)), F.lit(0.0))


def state_flags(df: DataFrame) -> dict[str, Column]:
    alarm = F.col("alarm_code") if "alarm_code" in df.columns else F.lit(0)
    state = F.col("op_state") if "op_state" in df.columns else F.lit(config.RUNNING_STATE)
    return {"alarm_active": (alarm != 0).cast("int"),
            "is_running": (state == config.RUNNING_STATE).cast("int"),
            "is_off": (state == config.OFF_STATE).cast("int")}


def alarm_streak(df: DataFrame, keys: list[str], ts: str, tie: str, limit: int | None = None,
                 hot=series.MEASURE) -> DataFrame:
    """Length so far of the current run of alarm rows; 0 outside alarms."""
    return series.chained(df, keys, lambda frame, h: _streaks(frame, keys, ts, tie, limit, h), limit, hot)


def _streaks(df: DataFrame, keys: list[str], ts: str, tie: str, limit: int | None, hot) -> DataFrame:
    placed = series.positions(df, keys, ts, tie, "__at", limit, hot)

    def starts(frame: DataFrame, part: list[str]) -> DataFrame:
        before = F.lag("alarm_active").over(Window.partitionBy(*part).orderBy(ts, tie))
        begins = before.isNull() | (before != F.col("alarm_active"))
        return frame.withColumn("__start", F.when(begins, F.col("__at")))

    begun = series.over_series(placed, keys, ts, tie, starts, behind=1, limit=limit, hot=hot)
    filled = series.fill_forward(begun, keys, ts, tie, ["__start"], limit, hot)
    streak = (F.col("__at") - F.col("__start") + 1) * F.col("alarm_active")
    return filled.withColumn("alarm_streak", streak).drop("__at", "__start")


def lags(df: DataFrame, part: list[str], order: list[str], signals: list[str] | None = None,
         periods: dict[str, int] | None = None) -> dict[str, Column]:
    """Value n rows earlier, 0 where the series is shorter."""
    window = Window.partitionBy(*part).orderBy(*order)
    return {f"{s}_lag_{label}": F.coalesce(F.lag(s, n).over(window), F.lit(0.0))
            for label, n in (periods or config.LAGS).items()
            for s in signals or config.LAG_SIGNALS if s in df.columns}


def add_features(df: DataFrame, keys: list[str] | None = None, ts: str = "timestamp", tie: str = "row_id",
                 frames: dict[str, int] | None = None, periods: dict[str, int] | None = None,
                 daily: str = "24h", limit: int | None = None, hot=series.MEASURE) -> DataFrame:
    """All features. One shuffle by device serves every window of the step."""
    keys = keys or config.SERIES_KEYS
    frames, periods = frames or config.FRAMES, periods or config.LAGS

    def step(frame: DataFrame, part: list[str]) -> DataFrame:
        order = [ts, tie]
        frame = rolling(frame, part, order, frames=frames, extremes=daily)
        frame = frame.withColumns(row_kpis(frame, daily))
        delta = counter_step(part, order) if "kwh_total" in frame.columns else F.lit(0.0)
        frame = frame.withColumns({"kwh_daily_delta": delta, **state_flags(frame)})
        return frame.withColumns(lags(frame, part, order, periods=periods))

    behind = max(frames.values()) + max(periods.values())

    def chain(frame: DataFrame, long) -> DataFrame:
        featured = series.over_series(frame, keys, ts, tie, step, behind=behind, limit=limit, hot=long)
        return _streaks(featured, keys, ts, tie, limit, long)

    return series.chained(df, keys, chain, limit, hot).withColumns(time_encodings(F.col(ts)))
