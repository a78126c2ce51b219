"""Per-series index: what must cross a chunk border when sensors have null runs.

One pass over the readings (partial aggregation in the scan tasks, no row shuffle)
gives, per block of rows and sensor, the first value present and the decayed sums at
the block's end. From that small table follow, for every chunk, the exponentially
weighted means a null run at its start repeats, and the next value after its end.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import DataFrame, functions as F

from ..config import LAYOUT, Layout, SPANS
from ..storage import written
from .chunks import CHUNK, carry, div
from .ewma import decay, reach


def series_facts(df: DataFrame, sensors, key: str = "site") -> tuple[list[str], bool]:
    """Sensors that have any null (the others need no index at all), and whether a series starts at
    another position than 0. One pass and one row; series with gaps in their positions are refused."""
    per = df.groupBy(key).agg(F.min("seq").alias("_lo"), F.max("seq").alias("_hi"), F.count("*").alias("_n"),
                              *[F.max(F.col(c).isNull()).alias(c) for c in sensors])
    row = per.agg(F.max(F.col("_hi") - F.col("_lo") + 1 - F.col("_n")).alias("_off"), F.max(F.abs("_lo")).alias("_start"),
                  *[F.max(c).alias(c) for c in sensors]).first()
    if row["_off"]:
        raise ValueError("the positions of a series must follow each other; number the frame again")
    return [c for c in sensors if row[c]], bool(row["_start"])


def series_starts(df: DataFrame, key: str = "site") -> DataFrame:
    return df.groupBy(key).agg(F.min("seq").alias("_first"))


def series_index(df: DataFrame, sensors, spans=SPANS, key: str = "site", layout: Layout = LAYOUT) -> DataFrame:
    """(site, blk, n, per sensor f_/fs_ first value and its seq, per span n_/d_ sums)."""
    b = layout.block
    to_end = (b - 1) - F.col("seq") % b
    weight = {s: F.exp(to_end * F.lit(log(decay(s)))) for s in spans}
    aggs = [F.count("*").alias("n")]
    for c in sensors:
        v = F.col(c)
        pos = F.when(v.isNotNull(), F.col("seq"))
        aggs += [F.min_by(v, pos).alias(f"f_{c}"), F.min(pos).alias(f"fs_{c}")]
        for s in spans:
            aggs += [F.sum(v * weight[s]).alias(f"n_{c}_{s}"),
                     F.sum(F.when(v.isNotNull(), weight[s])).alias(f"d_{c}_{s}")]
    return written(df.groupBy(key, div("seq", b).alias("blk")).agg(*aggs), "series-index")


def _block_means(index: DataFrame, pairs, key: str, layout: Layout) -> DataFrame:
    """Mean at each block's last value; null for a block without values."""
    b = layout.block
    depth = max(ceil(reach(s) / b) for _, s in pairs)
    sums = [f"{p}_{c}_{s}" for c, s in pairs for p in "nd"]
    out = index
    for k in range(1, depth + 1):
        out = out.join(index.select(key, (F.col("blk") + k).alias("blk"), *[F.col(c).alias(f"p{k}{c}") for c in sums]),
                       [key, "blk"], "left")

    def total(p, c, s):
        return sum((F.coalesce(F.col(f"p{k}{p}_{c}_{s}"), F.lit(0.0)) * decay(s) ** (k * b)
                    for k in range(1, depth + 1)), start=F.col(f"{p}_{c}_{s}"))

    return out.select("*", *[
        F.when(F.col(f"d_{c}_{s}") > 0, total("n", c, s) / total("d", c, s)).alias(f"in_{c}_{s}") for c, s in pairs])


def chunk_entries(index: DataFrame, sensors, spans=SPANS, key: str = "site", layout: Layout = LAYOUT) -> DataFrame:
    """One row per (site, chunk): ``in_<sensor>_<span>`` (mean before the chunk),
    ``nx_``/``nxs_`` (first value after it and its seq) and ``n_rows``."""
    pairs = [(c, s) for c in sensors for s in spans]
    firsts = [f"{p}_{c}" for c in sensors for p in ("f", "fs")]
    per = layout.chunk // layout.block
    at_start = F.col("blk") % per == 0
    later = carry(index, "blk", firsts, key, forward=False, fan=layout.fan).filter(at_start)
    here = index.filter(at_start).select(key, "blk", *[F.col(c).alias("h" + c) for c in firsts])
    nxt = later.join(here, [key, "blk"]).select(
        key, (div("blk", per) - 1).alias(CHUNK),
        *[F.coalesce(F.col("h" + c), F.col(c)).alias("nx" + c[1:]) for c in firsts])
    if pairs:
        means = _block_means(index, pairs, key, layout)
        out = carry(means, "blk", [f"in_{c}_{s}" for c, s in pairs], key, fan=layout.fan).filter(at_start)
    else:
        out = index.filter(at_start).select(key, "blk")
    sizes = index.groupBy(key).agg(F.sum("n").alias("n_rows"))
    return out.withColumn(CHUNK, div("blk", per)).drop("blk").join(nxt, [key, CHUNK], "left").join(sizes, key)
