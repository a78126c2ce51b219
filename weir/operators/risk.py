"""Smoothed risk series."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import LAYOUT, RISK_SPAN, Layout
from ..functions.scoring import clip_risk, risk_raw
from .chunks import own_rows, with_chunks
from .ewma import SUB, block_sums, halo_rows, mean_expr, previous_block
from .sites import with_site_values


def chunked_risk(df: DataFrame, span: int = RISK_SPAN, extra: int = 0, layout: Layout = LAYOUT) -> DataFrame:
    """Rows with ``risk_raw`` and ``risk``, still cut into chunks; the halo's last
    ``extra`` rows carry an exact risk too, for windows on top of it."""
    raw = df.withColumn("risk_raw", risk_raw(df.columns))
    cut = with_chunks(raw, halo_rows([span], extra, layout), layout)
    out = block_sums(cut, [("risk_raw", span)], layout=layout).selectExpr("*", previous_block(layout=layout))
    # risk_raw is never null, so there is nothing to carry across chunks
    return out.withColumn("risk", clip_risk(F.expr(mean_expr("risk_raw", span, layout)))).drop("_dec", "_full", "_prev")


def risk_series(df: DataFrame, span: int = RISK_SPAN, layout: Layout = LAYOUT) -> DataFrame:
    """Add ``risk_raw`` and ``risk`` (EWMA-smoothed, clipped to 0..100) to numbered readings."""
    return own_rows(chunked_risk(df, span, layout=layout), layout).drop("_chunk", SUB)


def last_n(df: DataFrame, n: int, key: str = "site") -> DataFrame:
    """The last ``n`` readings of each site, renumbered from 0 (``n`` <= 0: all of them).

    Needs no window: positions and series sizes decide. The sizes are one row per site.
    """
    if n <= 0:
        return df
    sizes = df.groupBy(key).agg((F.max("seq") + 1).alias("n_rows"))
    start = F.greatest(F.col("n_rows") - n, F.lit(0))
    return (
        with_site_values(df, sizes, key)
        .filter(F.col("seq") >= start)
        .withColumn("seq", F.col("seq") - start)
        .drop("n_rows")
    )
