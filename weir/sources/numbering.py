"""Distributed row numbers inside a series.

``row_number() over (partition by site order by ts)`` sorts a whole site in one
task. Here the rows are range-partitioned on (site, order) instead, so a site of any
size spreads over as many tasks as it needs; each task numbers its sorted run, and
the runs' start numbers come from a table with one row per (run, site).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..storage import written

_ROW_BITS = (1 << 33) - 1


def number_series(df: DataFrame, key: str = "site", order: tuple[str, ...] = ("ts",),
                  partitions: int | None = None) -> DataFrame:
    """Add ``seq``: 0-based position of each row in its series, in ``order``.

    ``order`` must be unique within ``key``. The sorted rows are written once, so the
    run a row belongs to cannot change between the counting and the joining pass.
    """
    keys = [key, *order]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    runs = written(
        ranged.sortWithinPartitions(*keys)
        .withColumn("_run", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))),
        "numbered",
    )
    # one row per (run, series): at most #runs + #series rows
    starts = runs.groupBy(key, "_run").agg(F.min("_pos").alias("_lo"), F.count("*").alias("_n"))
    before = W.partitionBy(key).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    starts = written(
        starts.select(key, "_run", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_lo")).alias("_shift")),
        "run-starts",
    )
    return (
        runs.join(starts, [key, "_run"])
        .withColumn("seq", F.col("_pos") + F.col("_shift"))
        .drop("_run", "_pos", "_shift")
    )


def series_sizes(df: DataFrame, key: str = "site", position: str = "seq") -> DataFrame:
    """Rows per series, from the numbering (map-side max, one row per series)."""
    return df.groupBy(key).agg((F.max(position) + 1).alias("n_rows"))
