"""The rolling features of a device on a stream, equal to those a batch computes over its whole history.

Readings wait in state until the watermark has passed them, so a late one takes its place in time first; what comes after the
watermark is dropped by Spark. Released readings are worked off in order of time:

* the last rows of a device, as many as the longest lag or frame reaches, lie in a map state in blocks of `BLOCK` rows; a
  micro-batch reads the blocks its frames and lags touch, writes those that got rows, and removes those out of reach, so its
  work follows the new rows and not the length of the history;
* the counter and the alarm streak need one row of state;
* a timer at the first waiting reading releases it when nothing new comes for the device. With `forget`, another timer clears a
  device that has been silent for so long; its history then starts anew.

Frames and lags count rows, as in `operators.features`, whose column names and rules the result has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sunloom import config
from sunloom.functions.timeparts import time_encodings
from sunloom.operators import features

BLOCK = 72
#: Rows whose frames are laid out at once, blocks whose running values are taken at once, rows of a device that are worked off at once.
ROWS, BLOCKS, SLICE = 2048, 256, 50_000
#: Rows up to which frames are taken one by one, with the same digits as in a batch.
FEW_ROWS = 2048


def _laid_out(part: np.ndarray, rows: int, extremes: bool) -> list[np.ndarray]:
    """`frame_stats` of all frames of `part`, every frame by itself: the work is rows times frame."""
    out: list[list[np.ndarray]] = [[] for _ in range(4 if extremes else 2)]
    for at in range(rows - 1, len(part), ROWS):
        seen = np.lib.stride_tricks.sliding_window_view(part[at - rows + 1:min(at + ROWS, len(part))], rows, axis=0)
        held = ~np.isnan(seen)
        n = held.sum(axis=2)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(n > 0, np.where(held, seen, 0.0).sum(axis=2) / n, np.nan)
            squares = (np.where(held, seen - mean[:, :, None], 0.0) ** 2).sum(axis=2)
            out[0].append(mean)
            out[1].append(np.where(n > 1, np.sqrt(squares / (n - 1)), 0.0))
        if extremes:
            out[2].append(np.where(n > 0, np.where(held, seen, np.inf).min(axis=2), np.nan))
            out[3].append(np.where(n > 0, np.where(held, seen, -np.inf).max(axis=2), np.nan))
    return [np.concatenate(x) for x in out]


def _running(blocks: np.ndarray) -> list[np.ndarray]:
    """Count, mean and squared deviations of the first 1, 2, ... rows of every block (block, row, signal)."""
    out = [np.empty(blocks.shape) for _ in range(3)]
    n, mean, squares = (np.zeros((len(blocks), blocks.shape[2])) for _ in range(3))
    for k in range(blocks.shape[1]):
        x = blocks[:, k]
        held = ~np.isnan(x)
        x = np.where(held, x, mean)
        n = n + held
        off = x - mean
        mean = mean + off / np.maximum(n, 1)
        squares = squares + off * (x - mean)
        for stat, value in zip(out, (n, mean, squares)):
            stat[:, k] = value
    return out


def _by_blocks(part: np.ndarray, rows: int, extremes: bool) -> list[np.ndarray]:
    """The same in work that follows the rows: a frame is the end of one block of `rows` rows and the beginning of the next."""
    frames = len(part) - rows + 1
    count = -(-len(part) // rows)
    blocks = np.full((count * rows, part.shape[1]), np.nan)
    blocks[:len(part)] = part
    blocks = blocks.reshape(count, rows, -1)
    flipped, flat = blocks[:, ::-1], (count * rows, part.shape[1])
    # a frame that is a whole block has no second part
    whole = (np.arange(frames) % rows == 0)[:, None]
    n1, mean1, squares1 = (x[:, ::-1].reshape(flat)[:frames] for x in _running(flipped))
    n2, mean2, squares2 = (x.reshape(flat)[rows - 1:rows - 1 + frames] for x in _running(blocks))
    n2 = np.where(whole, 0.0, n2)
    n = n1 + n2
    share, off = n2 / np.maximum(n, 1), mean2 - mean1
    squares = squares1 + np.where(whole, 0.0, squares2) + off ** 2 * n1 * share
    out = [np.where(n > 0, mean1 + off * share, np.nan), np.where(n > 1, np.sqrt(squares / np.maximum(n - 1, 1)), 0.0)]
    if extremes:
        for least in (np.fmin, np.fmax):
            end = least.accumulate(flipped, axis=1)[:, ::-1].reshape(flat)[:frames]
            out.append(least(end, np.where(whole, np.nan, least.accumulate(blocks, axis=1).reshape(flat)[rows - 1:rows - 1 + frames])))
    return out


def frame_stats(values: np.ndarray, rows: int, first: int, extremes: bool) -> list[np.ndarray]:
    """Mean and sample deviation (least, largest) of the frames that end at rows first, first + 1, ... of `values`.

    Missing values don't count; frames are shorter at the start of the series, marked by missing rows.
    """
    out, step = [], BLOCKS * rows
    for at in range(first, len(values), step):
        part = values[at - rows + 1:min(at + step, len(values))]
        # an infinite value would stay in running values
        short = len(part) < max(2 * rows, FEW_ROWS) or np.isinf(part).any()
        out.append((_laid_out if short else _by_blocks)(part, rows, extremes))
    return [np.concatenate(x) for x in zip(*out)]


class Rolling(StatefulProcessor):
    """Input columns after the keys: ts, tie, the signals, string_imbalance, counter, alarm, further columns."""

    def __init__(self, keys: list[str], columns: list[str], signals: list[str], frames: dict[str, int], extremes: str, lags: dict[str, int],
                 lag_signals: list[str], block: int, forget_ms: int | None, order: list[str]):
        self.keys, self.columns, self.signals, self.frames, self.extremes, self.order = keys, columns, signals, frames, extremes, order
        self.lags, self.lag_signals, self.block, self.forget_ms = lags, lag_signals, block, forget_ms
        self.held = [*signals, "string_imbalance", "power_variability"]
        self.reach = max([*frames.values(), *[n + 1 for n in lags.values()]])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "block long", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")
        self.last = handle.getValueState("last", "n long, counter double, alarm double, streak long, seen long")

    def close(self) -> None:
        pass

    # ---------------------------------------------------------------------------------------------------- input
    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = []
        for frame in rows:
            # Spark gives columns that start with an underscore other names
            frame.columns = [*self.keys, "__time", "__ts", "__tie", *self.columns]
            values = np.empty((len(frame), 2 + len(self.columns)))
            whole = values.view(np.int64)
            whole[:, 0] = frame["__ts"].to_numpy("int64")
            whole[:, 1] = frame["__tie"].to_numpy("int64")
            values[:, 2:] = frame[self.columns].to_numpy("float64")
            parts.append(values)
        new = np.concatenate(parts) if parts else np.empty((0, 2 + len(self.columns)))
        yield from self.released(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.released(key, np.empty((0, 2 + len(self.columns))), timerValues.getCurrentWatermarkInMs())

    def released(self, key, new: np.ndarray, watermark: int) -> Iterator[pd.DataFrame]:
        held = [np.frombuffer(r[0]).reshape(-1, 2 + len(self.columns)) for r in self.waiting.get()]
        rows = np.concatenate([*held, new])
        at, tie = rows.view(np.int64)[:, 0], rows.view(np.int64)[:, 1]
        ready = at < watermark * 1000
        rest = rows[~ready]
        if len(rest):
            if held and not ready.any() and len(new):
                self.waiting.appendValue((new.tobytes(),))
            elif not held or ready.any():
                self.waiting.put([(rest.tobytes(),)])
            self.handle.registerTimer(int(rest.view(np.int64)[:, 0].min() // 1000 + 1))
        elif held:
            self.waiting.clear()
        if ready.any():
            order = np.flatnonzero(ready)[np.lexsort((tie[ready], at[ready]))]
            for start in range(0, len(order), SLICE):
                yield self.worked(key, rows[order[start:start + SLICE]])
            if self.forget_ms is not None:
                self.handle.registerTimer(int(at[order[-1]] // 1000 + self.forget_ms))
        elif self.forget_ms is not None and not len(rest) and self.last.exists() and self.last.get()[4] // 1000 + self.forget_ms <= watermark:
            self.blocks.clear()
            self.last.clear()

    # ------------------------------------------------------------------------------------------------- features
    def history(self, low: int, high: int) -> np.ndarray:
        """Stored rows low .. high - 1; rows before the first are missing."""
        out = np.full((max(high - low, 0), len(self.held)), np.nan)
        for block in range(max(low, 0) // self.block, (high - 1) // self.block + 1 if high > 0 else 0):
            found = self.blocks.getValue((block,))
            if found is None:
                continue
            rows = np.frombuffer(found[0]).reshape(-1, len(self.held))
            a, b = max(low, block * self.block), min(high, block * self.block + len(rows))
            if a < b:
                out[a - low:b - low] = rows[a - block * self.block:b - block * self.block]
        return out

    def worked(self, key, rows: np.ndarray) -> pd.DataFrame:
        """Features of rows that follow the stored ones, in order of time."""
        n, counter, alarm, streak, _ = self.last.get() if self.last.exists() else (0, None, 0.0, 0, 0)
        count, values = len(rows), dict(zip(self.columns, rows[:, 2:].T))
        widest = max(self.frames.values())
        before = self.history(n - widest + 1, n)
        mine = np.column_stack([values[s] for s in [*self.signals, "string_imbalance"]] + [np.full(count, np.nan)])
        joined = np.vstack([before, mine])
        out = {}
        for label, size in self.frames.items():
            stats = frame_stats(joined[:, :len(self.signals)], size, widest - 1, label == self.extremes)
            for name, stat in zip(("rmean", "rstd", "rmin", "rmax"), stats):
                out |= {f"{s}_{name}_{label}": stat[:, i] for i, s in enumerate(self.signals)}
        mean, std = out.get(f"power_rmean_{self.extremes}"), out.get(f"power_rstd_{self.extremes}")
        if mean is not None:
            mine[:, -1] = np.divide(std, mean, out=np.zeros(count), where=mean > 0)
        else:
            mine[:, -1] = 0.0
        for label, size in self.lags.items():
            # of the rows `size` earlier some are stored, the others came now
            old = self.history(n - size, min(n, n + count - size))
            earlier = np.vstack([old, mine[:max(count - size, 0)]])
            for s in self.lag_signals:
                out[f"{s}_lag_{label}"] = np.nan_to_num(earlier[:, self.held.index(s)], nan=0.0)
        grown = np.diff(values["__counter"], prepend=np.nan if counter is None else counter)
        out["kwh_daily_delta"] = np.maximum(np.nan_to_num(grown, nan=0.0), 0.0)
        active = np.nan_to_num(values["__alarm"], nan=0.0) != 0
        place = np.arange(count)
        # the last row without alarm; before the first one the stored streak goes on
        quiet = np.maximum.accumulate(np.where(active, -1, place))
        out["alarm_streak"] = np.where(active, place - quiet + np.where(quiet < 0, streak, 0), 0)
        self.store(n, mine)
        at = rows.view(np.int64)[:, 0]
        last_counter = float(values["__counter"][-1])
        self.last.update((n + count, None if np.isnan(last_counter) else last_counter, float(active[-1]), int(out["alarm_streak"][-1]), int(at[-1])))
        fixed = {k: np.full(count, v) for k, v in zip(self.keys, key)}
        return pd.DataFrame(fixed | {"__ts": at, "__tie": rows.view(np.int64)[:, 1]} | values | out)[self.order]

    def store(self, n: int, mine: np.ndarray) -> None:
        total = n + len(mine)
        first = max(total - self.reach, 0)
        block = max(n, first) // self.block
        while block * self.block < total:
            low, high = block * self.block, min((block + 1) * self.block, total)
            rows = mine[max(low, n) - n:high - n]
            if low < n:
                rows = np.vstack([self.history(low, n), rows])
            self.blocks.updateValue((block,), (rows.tobytes(),))
            block += 1
        # blocks that this batch has put out of reach
        for gone in range(max(n - self.reach, 0) // self.block, min(first // self.block, (n - 1) // self.block + 1 if n else 0)):
            self.blocks.removeKey((gone,))


def rolling_features(stream: DataFrame, keys: list[str] | None = None, ts: str = "timestamp", tie: str = "row_id", late: str = "10 minutes",
                     frames: dict[str, int] | None = None, lags: dict[str, int] | None = None, daily: str = "24h",
                     block: int = BLOCK, forget_days: int | None = None) -> DataFrame:
    """`operators.features.add_features` on a stream. Numeric columns stay beside the features, others are left out.

    `tie` is a whole number that orders readings of one time. Keys must not be null.
    """
    keys, frames, lags = keys or config.SERIES_KEYS, frames or config.FRAMES, lags or config.LAGS
    rows = stream.withColumn("string_imbalance", features.string_imbalance(stream))
    signals = [s for s in config.ROLLING_SIGNALS if s in rows.columns]
    lag_signals = [s for s in config.LAG_SIGNALS if s in [*signals, "string_imbalance", "power_variability"]]
    special = {ts, tie, *keys, *signals, "string_imbalance"}
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    further = [c for c, k in kinds.items() if c not in special and isinstance(k, T.NumericType)]
    given = {"__counter": F.col("kwh_total") if "kwh_total" in kinds else F.lit(None),
             "__alarm": F.col("alarm_code") if "alarm_code" in kinds else F.lit(0)}
    columns = [*signals, "string_imbalance", *given, *further]
    wanted = rows.withColumns(given).select(*keys, F.col(ts).alias("__time"), F.unix_micros(ts).alias("__ts"), F.col(tie).cast("bigint").alias("__tie"),
                                            *[F.col(c).cast("double").alias(c) for c in columns])
    made = [f"{s}_{k}_{label}" for label in frames for k in ("rmean", "rstd", *(("rmin", "rmax") if label == daily else ())) for s in signals]
    made += [f"{s}_lag_{label}" for label in lags for s in lag_signals] + ["kwh_daily_delta"]
    schema = T.StructType([T.StructField(k, kinds[k]) for k in keys] + [T.StructField(c, T.LongType()) for c in ("__ts", "__tie")]
                          + [T.StructField(c, T.DoubleType()) for c in [*columns, *made]] + [T.StructField("alarm_streak", T.LongType())])
    forget = None if forget_days is None else forget_days * 86_400_000
    work = Rolling(keys, columns, signals, frames, daily, lags, lag_signals, block, forget, schema.fieldNames())
    done = wanted.withWatermark("__time", late).groupBy(*keys).transformWithStateInPandas(work, schema, "append", "EventTime")
    back = done.select(*keys, F.timestamp_micros("__ts").alias(ts), F.col("__tie").cast(kinds[tie]).alias(tie),
                       *[F.col(c).cast(kinds[c]).alias(c) for c in [*signals, *further]], "string_imbalance", *made, F.col("alarm_streak").cast("int"))
    back = back.withColumns(features.row_kpis(back, daily))
    return back.withColumns({**features.state_flags(back), **time_encodings(F.col(ts))})
