"""Time-ordered splits and targets.

All are arithmetic on positions and series sizes. Positions must run from 0 without gaps;
a frame that lost rows (features with nulls dropped) is numbered again with
:func:`frame_positions`, and split by ``pos``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import HORIZON, LAYOUT, Layout
from ..sources.numbering import number_series, series_sizes
from .chunks import CHUNK, div, in_chunk, own_rows, with_chunks
from .sites import with_site_values


def frame_positions(df: DataFrame, key: str = "site") -> DataFrame:
    """Add ``pos``: the row's position among the rows its series has in this frame. Written once."""
    numbered = number_series(df.withColumnRenamed("seq", "_at"), key, ("_at",))
    return numbered.withColumnRenamed("seq", "pos").withColumnRenamed("_at", "seq").select(*df.columns, "pos")


def blocked_split(df: DataFrame, n_splits: int = 4, key: str = "site", position: str = "seq") -> DataFrame:
    """One row per (reading, fold it takes part in) with ``fold`` 1..n_splits-1 and ``role``.

    Fold f trains on the series' first f blocks and validates on the next one; rows
    beyond ``n_splits`` whole blocks are unused.
    """
    block = ((F.col("n_rows") - F.col("n_rows") % n_splits) / n_splits).cast("bigint")
    rows = with_site_values(df, series_sizes(df, key, position), key, position=position).withColumn("_b", block)
    at = F.col(position)
    rows = rows.filter((F.col("_b") > 0) & (at < F.col("_b") * n_splits))
    part = ((at - at % F.col("_b")) / F.col("_b")).cast("int")
    first = F.greatest(part, F.lit(1))
    folds = F.explode(F.sequence(first, F.lit(n_splits - 1)))
    return (rows.withColumn("_part", part).filter(F.lit(n_splits) > 1).withColumn("fold", folds)
            .withColumn("role", F.when(F.col("_part") == F.col("fold"), "validate").otherwise("train"))
            .drop("_b", "_part", "n_rows"))


def fold_rows(df: DataFrame, fold: int, n_splits: int = 4, size: str = "frame_rows", position: str = "pos") -> DataFrame:
    """One fold of :func:`blocked_split` of a frame that has its series' sizes in ``size``: row by row, so nothing moves."""
    at, block = F.col(position), div(size, n_splits)
    own = F.greatest(block, F.lit(1))
    part = ((at - at % own) / own).cast("int")
    rows = df.filter((block > 0) & (at < block * n_splits) & (part <= fold))
    return rows.withColumn("fold", F.lit(fold)).withColumn("role", F.when(part == fold, "validate").otherwise("train"))


def ordered_split(df: DataFrame, fraction: float = 0.75, per_site: bool = True, key: str = "site",
                  position: str = "seq") -> DataFrame:
    """Add ``role``: the first ``fraction`` of each series trains, the rest validates.
    ``per_site=False`` cuts the (site, time)-ordered whole instead, which holds out the last sites."""
    sizes = series_sizes(df, key, position)
    if per_site:
        cut = F.floor(F.col("n_rows") * fraction)
        at = F.col(position)
    else:
        # over one row per site, not over readings
        before = W.orderBy(key).rowsBetween(W.unboundedPreceding, -1)
        sizes = sizes.withColumn("_before", F.coalesce(F.sum("n_rows").over(before), F.lit(0)))
        total = sizes.agg(F.sum("n_rows").alias("_total"))
        sizes = sizes.crossJoin(F.broadcast(total))  # one row
        cut, at = F.floor(F.col("_total") * fraction), F.col("_before") + F.col(position)
    out = with_site_values(df, sizes, key, position=position).withColumn("role", F.when(at < cut, "train").otherwise("validate"))
    return out.select(*df.columns, "role")


def forecast_targets(df: DataFrame, sensors, horizon: int = HORIZON, key: str = "site", position: str = "seq",
                     layout: Layout = LAYOUT) -> DataFrame:
    """Add ``target_<sensor>``: the sensor's value ``horizon`` rows of the frame later (null beyond its
    end). Each chunk also gets the ``horizon`` rows after it, so one exchange serves all sensors."""
    at = F.col(position)
    mine, before = div(at, layout.chunk), div(F.greatest(at - horizon, F.lit(0)), layout.chunk)
    # a row ahead of its chunk brings nothing but the values to be looked up
    cut = df.withColumn(CHUNK, F.explode(F.sequence(before, mine))).repartition(key, CHUNK)
    there = W.partitionBy(key, CHUNK).orderBy(position).rangeBetween(horizon, horizon)
    later = F.first(F.struct(*[F.col(s) for s in sensors])).over(there)
    out = cut.withColumn("_later", later).filter(F.col(CHUNK) == mine)
    return out.select(*df.columns, *[F.col(f"_later.{s}").alias(f"target_{s}") for s in sensors])


def forecast_target(df: DataFrame, sensor: str, horizon: int = HORIZON, key: str = "site", position: str = "seq") -> DataFrame:
    """Add ``target``: the sensor's value ``horizon`` rows later; rows without one are dropped."""
    return forecast_targets(df, [sensor], horizon, key, position).withColumnRenamed(f"target_{sensor}", "target").filter("target IS NOT NULL")


def lagged(df: DataFrame, exprs: dict[str, tuple[str, int]], layout: Layout = LAYOUT, key: str = "site") -> DataFrame:
    """Add plain lags {name: (column, k)} on one exchange, without back-fill."""
    cut = with_chunks(df, max(k for _, k in exprs.values()), layout, key)
    w = in_chunk(key)
    cut = cut.select("*", *[F.lag(c, k).over(w).alias(n) for n, (c, k) in exprs.items()])
    return own_rows(cut, layout).drop(CHUNK)
