"""Rolling z-scores and their flags; the isolation forest lives in `learning.forest`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunloom import config


def add_zscores(df: DataFrame, daily: str = "24h", signals: list[str] | None = None,
                limit: float = config.ZSCORE_LIMIT) -> DataFrame:
    """|x - mean| / std against the daily frame, reusing the rolling columns; a zero std counts as 1.

    A single-row frame has rolling std 0 here, so it also divides by 1.
    """
    present = [s for s in signals or config.ZSCORE_SIGNALS if f"{s}_rmean_{daily}" in df.columns]
    if not present:
        return df.withColumn("zscore_anomaly", F.lit(0))
    scores = {}
    for s in present:
        std = F.col(f"{s}_rstd_{daily}")
        scores[f"{s}_zscore"] = F.abs((F.col(s) - F.col(f"{s}_rmean_{daily}")) / F.when(std == 0, 1.0).otherwise(std))
    df = df.withColumns(scores)
    df = df.withColumns({f"{s}_zscore_flag": F.when(F.col(f"{s}_zscore") > limit, 1).otherwise(0) for s in present})
    flags = [F.col(f"{s}_zscore_flag") for s in present]
    return df.withColumn("zscore_anomaly", F.greatest(*flags) if len(flags) > 1 else reduce(lambda a, b: a, flags))
