"""Per-row scoring expressions. All are Column expressions, so they run inside
whole-stage codegen in batch and in streams alike."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from ..config import LIMITS, RISK_BANDS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def deviation_score(sensor: str, value=None) -> Column:
    """0..30 inside the limits (inclusive), 30..100 outside, 0 for null or unknown."""
    v = _col(sensor if value is None else value)
    lim = LIMITS.get(sensor)
    if lim is None:
        return F.lit(0.0)
    inside = F.least(30.0 * (F.abs(v - lim.mid) / lim.half), F.lit(30.0))
    below = F.least(30.0 + 70.0 * ((lim.low - v) / lim.half), F.lit(100.0))
    above = F.least(30.0 + 70.0 * ((v - lim.high) / lim.half), F.lit(100.0))
    return F.when(v.isNull(), 0.0).when(v < lim.low, below).when(v > lim.high, above).otherwise(inside)


def scored_sensors(columns) -> list[str]:
    return [s for s in LIMITS if s in columns]


def risk_raw(columns, prefix: str = "") -> Column:
    """Weighted mean deviation over the sensors that are present and not null."""
    have = [s for s in LIMITS if prefix + s in columns]
    if not have:
        return F.lit(0.0)
    value = {s: F.col(prefix + s) for s in have}
    total = reduce(add, [F.when(value[s].isNotNull(), LIMITS[s].weight * deviation_score(s, value[s])).otherwise(0.0)
                         for s in have])
    weight = reduce(add, [F.when(value[s].isNotNull(), LIMITS[s].weight).otherwise(0.0) for s in have])
    return F.coalesce(F.try_divide(total, weight), F.lit(0.0))


def clip_risk(c) -> Column:
    c = _col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0)))


def risk_level(c) -> Column:
    c = _col(c)
    out = F.when(c >= RISK_BANDS[0][0], RISK_BANDS[0][1])
    for bound, name in RISK_BANDS[1:]:
        out = out.when(c >= bound, name)
    return out.otherwise("excellent")


def potable_probability(risk) -> Column:
    return F.greatest(F.lit(0.0), 1 - _col(risk) / 100.0)


def physical_clip(sensor: str) -> Column:
    """Clamp to half the lower and one and a half times the upper limit."""
    lim, v = LIMITS[sensor], F.col(sensor)
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(0.5 * lim.low)), F.lit(1.5 * lim.high)))


def violates(sensor: str) -> Column:
    lim, v = LIMITS[sensor], F.col(sensor)
    return (v < lim.low) | (v > lim.high)
