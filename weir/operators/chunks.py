"""Cutting series into chunks and carrying values across the cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import LAYOUT, Layout

CHUNK = "_chunk"


def div(c, n: int) -> Column:
    """Whole-number division of a non-negative position."""
    c = F.col(c) if isinstance(c, str) else c
    return ((c - c % n) / n).cast("bigint")



def chunk_of(seq="seq", layout: Layout = LAYOUT) -> Column:
    return div(seq, layout.chunk)


def with_chunks(df: DataFrame, halo: int, layout: Layout = LAYOUT, key: str = "site") -> DataFrame:
    """Assign rows to chunks, repeating the last ``halo`` rows before each chunk in it.

    Rows before ``_chunk * chunk`` only feed windows and are dropped by :func:`own_rows`.
    """
    if halo:
        last = div(F.col("seq") + halo, layout.chunk)
        cut = df.withColumn(CHUNK, F.explode(F.sequence(chunk_of(layout=layout), last)))
    else:
        cut = df.withColumn(CHUNK, chunk_of(layout=layout))
    # one exchange on (site, chunk) serves every window below, also those on finer keys
    return cut.repartition(key, CHUNK)


def is_own(layout: Layout = LAYOUT) -> Column:
    return F.col("seq") >= F.col(CHUNK) * layout.chunk


def own_rows(df: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    return df.filter(is_own(layout))


def in_chunk(key: str = "site"):
    return W.partitionBy(key, CHUNK).orderBy("seq")


def carry(df: DataFrame, idx: str, cols: list[str], key: str = "site", forward: bool = True,
          fan: int = LAYOUT.fan) -> DataFrame:
    """For each row of an index table, the nearest earlier (or later) non-null of ``cols``.

    ``df`` holds one row per (key, idx). Two levels keep every window small: inside groups
    of ``fan`` index rows, then over the groups. ``df`` should be a written table, as it is
    scanned twice.
    """
    step = F.col(idx) if forward else -F.col(idx)
    grp = div(idx, fan)
    inner = W.partitionBy(key, "_grp").orderBy("_step")
    outer = W.partitionBy(key).orderBy(F.col("_grp") if forward else F.col("_grp").desc())
    strictly_before = (W.unboundedPreceding, -1)
    rows = df.select(key, idx, *cols).withColumns({"_grp": grp, "_step": step})
    pick = F.max_by if forward else F.min_by
    groups = rows.groupBy(key, "_grp").agg(
        *[pick(F.col(c), F.when(F.col(c).isNotNull(), F.col(idx))).alias(c) for c in cols]
    )
    groups = groups.select(key, "_grp", *[
        F.last(c, ignorenulls=True).over(outer.rowsBetween(*strictly_before)).alias(f"_g_{c}") for c in cols
    ])
    inside = rows.select(key, idx, "_grp", *[
        F.last(c, ignorenulls=True).over(inner.rowsBetween(*strictly_before)).alias(c) for c in cols
    ])
    return inside.join(groups, [key, "_grp"]).select(
        key, idx, *[F.coalesce(F.col(c), F.col(f"_g_{c}")).alias(c) for c in cols]
    )
