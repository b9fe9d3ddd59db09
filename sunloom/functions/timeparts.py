"""Time conversions and encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_epoch_ms(value: Column) -> Column:
    """Epoch milliseconds in any spelling to a timestamp; unreadable values become NULL."""
    return F.timestamp_millis(value.try_cast("double").cast("bigint"))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text, `Z` allowed; unreadable text becomes NULL."""
    return text.try_cast("timestamp")


def time_encodings(ts: Column) -> dict[str, Column]:
    """Hour of day and weekday on the circle plus the 06-18 daylight flag (Monday is 0)."""
    day_angle = (F.hour(ts) + F.minute(ts) / F.lit(60.0)) * F.lit(2 * math.pi / 24)
    week_angle = F.weekday(ts) * F.lit(2 * math.pi / 7)
    return {
        "hour_sin": F.sin(day_angle), "hour_cos": F.cos(day_angle),
        "dow_sin": F.sin(week_angle), "dow_cos": F.cos(week_angle),
        "is_daytime": F.hour(ts).between(6, 17).cast("int"),
    }


def age_text(ts: Column, as_of: Column) -> Column:
    """`Unknown`, `Just now`, `7 min ago`, `3h 5m ago`."""
    minutes = F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(60_000_000))
    hours = F.floor(minutes / F.lit(60))
    return (F.when(ts.isNull(), "Unknown").when(minutes < 1, "Just now")
            .when(minutes < 60, F.format_string("%d min ago", minutes))
            .otherwise(F.format_string("%dh %dm ago", hours, minutes % 60)))
