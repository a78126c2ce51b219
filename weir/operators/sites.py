"""Joins of readings with tables that hold one row per site."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Tasks that one site's readings are dealt over where the small table is not broadcast.
SALTS = 64
RUN = 512


def with_site_values(df: DataFrame, values: DataFrame, key: str = "site", how: str = "inner", position: str = "seq") -> DataFrame:
    """``df`` with the columns of ``values`` (one row per site). The small table is repeated per salt, and
    a site's readings are dealt by runs of positions, so no task gets a whole site."""
    spread = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    run = F.pmod((F.col(position) - F.pmod(F.col(position), F.lit(RUN))) / RUN, F.lit(SALTS)).cast("int")
    return df.withColumn("_salt", run).join(spread, [key, "_salt"], how).drop("_salt")
