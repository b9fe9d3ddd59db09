"""Devices that fall silent: an event-time timer per device, and blocks whose devices are all silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sunloom import config

CHANGES = "inverter_id {kind}, last_data_at timestamp, status string"


def connection_changes(readings: DataFrame, minutes: int = config.STALE_MINUTES, late: str = "1 minute") -> DataFrame:
    """`online` when a device is first heard or heard again, `offline` when the watermark passes its last data
    by more than `minutes`."""
    silence = minutes * 60_000_000

    def rows(key: tuple, found: list[tuple[int, str]]) -> pd.DataFrame:
        return pd.DataFrame({"inverter_id": [key[0]] * len(found), "status": [s for _, s in found],
                             "last_data_at": [pd.Timestamp(t, unit="us") for t, _ in found]})[
            ["inverter_id", "last_data_at", "status"]]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, online = state.get if state.exists else (0, False)
        if state.hasTimedOut:
            state.update((last, False))
            yield rows(key, [(last, "offline")])
            return
        found, passed = [], state.getCurrentWatermarkMs() * 1000
        # Gaps longer than the silence lie between buckets of that width: first and last time of each are enough,
        # so memory follows the time covered and not the number of rows.
        edges: dict[int, tuple[int, int]] = {}
        for batch in batches:
            times = batch["ts"].astype("datetime64[us]").astype("int64")
            for bucket, low, high in times.groupby(times // silence).agg(["min", "max"]).itertuples():
                first, end = edges.get(bucket, (low, high))
                edges[bucket] = (min(first, low), max(end, high))
        for moment in (int(t) for bucket in sorted(edges) for t in edges[bucket]):
            if moment <= last:
                continue
            if online and moment - last > silence:  # a gap inside one micro-batch, before any timer could fire
                found.append((last, "offline"))
                online = False
            if not online and moment + silence > passed:
                found.append((moment, "online"))
                online = True
            last = moment
        state.update((last, online))
        if online:
            state.setTimeoutTimestamp(max((last + silence) // 1000, passed // 1000 + 1))
        if found:
            yield rows(key, found)

    kind = dict(readings.dtypes)["inverter_id"]
    heard = readings.select("inverter_id", "ts").withWatermark("ts", late)
    return heard.groupBy("inverter_id").applyInPandasWithState(
        step, CHANGES.format(kind=kind), "last_us bigint, online boolean", "append", GroupStateTimeout.EventTimeTimeout)
