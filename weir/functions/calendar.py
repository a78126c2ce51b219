"""Clock and calendar expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, functions as F


def hour_of_day(ts="ts") -> Column:
    """Hours with minutes as a fraction; seconds do not count."""
    return F.hour(ts) + F.minute(ts) / 60.0


def time_encodings(ts="ts") -> dict[str, Column]:
    hour = hour_of_day(ts)
    day = F.weekday(F.col(ts))  # Monday = 0
    return {
        "hour_sin": F.sin(2 * pi * hour / 24),
        "hour_cos": F.cos(2 * pi * hour / 24),
        "dow_sin": F.sin(2 * pi * day / 7),
        "dow_cos": F.cos(2 * pi * day / 7),
        "is_night": F.when((F.hour(ts) >= 22) | (F.hour(ts) < 6), 1).otherwise(0),
    }


def add_time_encodings(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns(time_encodings(ts))


def diurnal_factor(ts="ts") -> Column:
    """Demand curve with peaks in the morning and the evening."""
    phase = 2 * pi * (hour_of_day(ts) - 7) / 24
    return 1 + 0.08 * F.sin(phase) + 0.04 * F.sin(2 * phase)
