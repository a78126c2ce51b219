"""Data-quality operators on numbered readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import HORIZON, LAYOUT, LIMITS, PHYSICAL_BOUNDS, Layout
from ..functions.calendar import diurnal_factor
from ..functions.scoring import physical_clip
from .features import add_ewma, present
from .sites import with_site_values
from .splits import lagged


def long_form(df: DataFrame, sensors=None, ids=("site", "ts", "seq")) -> DataFrame:
    """(ids, sensor, value): one row per reading and sensor; narrow, no shuffle."""
    ids = [c for c in ids if c in df.columns]
    return df.unpivot(ids, present(df, sensors), "sensor", "value")


def limits_table(spark):
    """The limits as a table of nine rows."""
    rows = [(s, lim.low, lim.high, lim.unit, lim.weight) for s, lim in LIMITS.items()]
    return spark.createDataFrame(rows, "sensor string, low double, high double, unit string, weight double")


def sensor_profile(df: DataFrame, sensors=None) -> DataFrame:
    """Mean, sample deviation, extremes, nulls and whether the limit line is in view, per sensor.

    Aggregated per column in one pass, then turned: no row is multiplied first."""
    have = present(df, sensors)
    one = df.agg(*[f(F.col(c)).alias(f"{n}_{c}") for c in have for n, f in (
        ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max),
        ("nn", lambda x: F.count_if(x.isNull())), ("n", lambda x: F.count(F.lit(1))))])
    turned = F.array(*[
        F.struct(F.lit(c).alias("sensor"), *[F.col(f"{n}_{c}").alias(m) for n, m in (
            ("mean", "mean"), ("std", "std"), ("min", "min"), ("max", "max"), ("nn", "n_null"), ("n", "n_rows"))],
            (F.lit(LIMITS[c].high) < 3 * F.col(f"max_{c}")).alias("limit_in_view"))
        for c in have])
    return one.select(F.inline(turned))


def limit_breaches(df: DataFrame, sensors=None, ids=("site", "ts", "seq")) -> DataFrame:
    """Readings outside their limits, one row per reading and sensor."""
    ids = [c for c in ids if c in df.columns]
    have = present(df, sensors)
    found = F.filter(
        F.array(*[F.when((F.col(s) < LIMITS[s].low) | (F.col(s) > LIMITS[s].high), F.struct(
            F.lit(s).alias("sensor"), F.col(s).alias("value"), F.lit(LIMITS[s].low).alias("low"),
            F.lit(LIMITS[s].high).alias("high"), F.lit(LIMITS[s].unit).alias("unit"))) for s in have]),
        lambda x: x.isNotNull())
    return df.select(*ids, F.inline(found))


def clip_readings(df: DataFrame, sensors=None) -> DataFrame:
    return df.withColumns({s: physical_clip(s) for s in present(df, sensors)})


def clip_bounds(df: DataFrame, bounds: dict = PHYSICAL_BOUNDS) -> DataFrame:
    out = {}
    for s, (lo, hi) in bounds.items():
        if s in df.columns:
            c = F.col(s)
            c = F.when(c < lo, F.lit(lo)).otherwise(c) if lo is not None else c
            out[s] = F.when(F.col(s) > hi, F.lit(hi)).otherwise(c) if hi is not None else c
    return df.withColumns(out)


def diurnal_adjust(df: DataFrame, sensors=("chloramine", "turbidity", "conductivity", "ph")) -> DataFrame:
    """Divide flow-sensitive sensors by the demand curve."""
    f = diurnal_factor("ts")
    return df.withColumns({f"{s}_adj": F.col(s) / f for s in present(df, sensors)})


def ewma_impute(df: DataFrame, sensors=None, span: int = 6, layout: Layout = LAYOUT) -> DataFrame:
    """Fill nulls with the exponentially weighted mean, i.e. the decayed last values."""
    have = present(df, sensors)
    filled = add_ewma(df, have, (span,), layout)
    return filled.select(*[c for c in df.columns if c not in have],
                         *[F.coalesce(F.col(c), F.col(f"{c}_ewma_{span}")).alias(c) for c in have])


def missing_flags(df: DataFrame, sensors=None, limit: float = 0.5, key: str = "site") -> DataFrame:
    """(site, sensor, missing_share, mostly_missing)."""
    have = present(df, sensors)
    agg = df.groupBy(key).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in have])
    return (agg.unpivot([key], have, "sensor", "missing_share")
            .withColumn("mostly_missing", F.col("missing_share") > limit))


def drift_flags(df: DataFrame, sensors=None, window: int = 72, sigmas: float = 2.0, layout: Layout = LAYOUT) -> DataFrame:
    """Flag rows whose rolling mean moved more than ``sigmas`` deviations from that of the
    ``window`` rows before. The deviation is the earlier window's."""
    from .features import Wanted, window_features

    have = present(df, sensors)
    rolled = window_features(df, Wanted(sensors=have, windows=(6, 12, 36, window)), layout=layout).select(
        "site", "ts", "seq", *[f"{c}_w{window}_{x}" for c in have for x in ("mean", "std")])
    lag = lagged(rolled, {f"{c}_{x}0": (f"{c}_w{window}_{x}", window) for c in have for x in ("mean", "std")}, layout)
    return lag.select("site", "ts", "seq", *[
        F.coalesce((F.abs(F.col(f"{c}_w{window}_mean") - F.col(f"{c}_mean0")) > sigmas * F.col(f"{c}_std0")).cast("int"),
                   F.lit(0)).alias(f"{c}_drift") for c in have])


def forecast_residuals(df: DataFrame, sensors=None, horizon: int = HORIZON, layout: Layout = LAYOUT) -> DataFrame:
    """Absolute residual of the naive forecast (the value ``horizon`` readings before) and its
    z-score per site and sensor; long form, rows without a forecast dropped."""
    have = present(df, sensors)
    wide = lagged(df.select("site", "ts", "seq", *have), {f"_{c}": (c, horizon) for c in have}, layout)
    wide = wide.select("site", "ts", "seq", *[F.abs(F.col(c) - F.col(f"_{c}")).alias(c) for c in have])
    stats = wide.groupBy("site").agg(*[F.avg(c).alias(f"m_{c}") for c in have],
                                     *[F.stddev_samp(c).alias(f"s_{c}") for c in have])
    joined = with_site_values(wide, stats)
    rows = F.array(*[F.struct(F.lit(c).alias("sensor"), F.col(c).alias("residual"),
                              F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")).alias("z")) for c in have])
    return joined.select("site", "ts", "seq", F.inline(rows)).filter("residual IS NOT NULL")


def amplified_risk(df: DataFrame, gain: float = 0.1, layout: Layout = LAYOUT) -> DataFrame:
    """Risk raised by how unusual the naive residuals are: risk * (1 + gain * mean positive z), at most 100."""
    from .risk import risk_series

    have = present(df)
    z = (forecast_residuals(df, have, layout=layout).groupBy("site", "seq")
         .agg(F.avg(F.greatest(F.col("z"), F.lit(0.0))).alias("z")))
    risk = risk_series(df, layout=layout).select("site", "ts", "seq", "risk")
    return risk.join(z, ["site", "seq"], "left").select(
        "site", "ts", "seq", "risk",
        F.least(F.lit(100.0), F.col("risk") * (1 + gain * F.coalesce(F.col("z"), F.lit(0.0)))).alias("amplified_risk"))
