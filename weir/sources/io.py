"""Reading and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..config import RAW_TO_SENSOR, SENSORS
from .numbering import number_series

READING_SCHEMA = T.StructType(
    [T.StructField("site", T.StringType()), T.StructField("ts", T.TimestampType())]
    + [T.StructField(s, T.DoubleType()) for s in SENSORS]
    + [T.StructField("potability", T.IntegerType()), T.StructField("event_type", T.StringType())])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing; in Spark it would compare greater than everything."""
    cols = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in cols})


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """The static sample table: sensor columns renamed, label as ``potability``. Columns are
    matched by header name, so order and absent columns do not matter; a cell that is no number is missing."""
    raw = spark.read.option("header", True).csv(path)
    known = {**RAW_TO_SENSOR, "Potability": "potability", "potability": "potability"}
    out = raw.select(*[F.col(f"`{c}`").try_cast("double").alias(known[c]) for c in raw.columns if c in known])
    if "potability" in out.columns:
        out = out.withColumn("potability", F.col("potability").try_cast("int"))
    return nan_to_null(out)


def read_readings(spark: SparkSession, path: str, sites=None) -> DataFrame:
    """Stored readings; a site filter prunes partitions."""
    df = spark.read.schema(READING_SCHEMA).parquet(path)
    return df.filter(F.col("site").isin(*sites)) if sites else df


def with_parsed_time(df: DataFrame, source: str = "timestamp", fmt: str | None = None) -> DataFrame:
    """String (or zone-less) time to ``ts``."""
    c = F.to_timestamp(source, fmt) if fmt else F.col(source).cast("timestamp")
    return df.withColumn("ts", c).drop(*([source] if source != "ts" else []))


def ingest(df: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Readings ready for the operators: nulls for NaN and a ``seq`` per site."""
    return number_series(nan_to_null(df), "site", order)


def union_sites(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_readings(df: DataFrame, path: str, mode: str = "error") -> None:
    """One table for both uses: a folder per site, and all sites together."""
    df.write.mode(mode).partitionBy("site").parquet(path)


CSV_TIME = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}  # whole microseconds


def write_csv(df: DataFrame, path: str, columns=None, mode: str = "error") -> None:
    cols = [c for c in (columns or df.columns) if c in df.columns]
    df.select(*cols).write.mode(mode).options(header=True, **CSV_TIME).csv(path)


def write_messages(df: DataFrame, path: str, mode: str = "error") -> None:
    """Feed messages, one JSON text per line."""
    from ..plans.views import messages

    messages(df).select(F.col("message").alias("value")).write.mode(mode).text(path)
