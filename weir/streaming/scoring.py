"""Stateless stream scoring: the batch expressions on a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.scoring import risk_level, risk_raw
from ..operators.diagnosis import rule_hits_column
from ..plans.views import message_column


def replay(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Stored readings as a stream, some files at a time (use ``trigger(availableNow=True)``)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def score_stream(stream: DataFrame) -> DataFrame:
    """Raw risk, level, first rule hit and feed message per reading. No state, no shuffle."""
    hits = rule_hits_column(stream.columns, raw_only=True)
    ids = [c for c in ("site", "ts", "seq") if c in stream.columns]
    scored = stream.withColumns({"risk_index": risk_raw(stream.columns), "_hits": hits})
    return scored.select(
        *ids, "risk_index", risk_level("risk_index").alias("risk_level"),
        F.coalesce(F.get("_hits", F.lit(0)).getField("cause"), F.lit("normal")).alias("cause"),
        message_column(stream.columns).alias("message"))


def write_slices(df: DataFrame, slices: Iterable[Column], path: str, files: int) -> None:
    """Lay rows out for replay: each slice is one job of ``files`` tasks that write a file each, and slices are
    written one after the other, so the file source (oldest first, ``files`` per trigger) plays them back in order."""
    for part in slices:
        df.filter(part).repartition(files).write.mode("append").parquet(path)


def write_in_time_order(df: DataFrame, path: str, slices: int, files: int) -> None:
    """Lay readings out in ``slices`` of event time, each of ``files`` files of like size."""
    us = F.unix_micros("ts")
    cuts = df.select(us.alias("us")).approxQuantile("us", [i / slices for i in range(1, slices)], 0.1 / slices)
    bounds = [None, *sorted({int(c) for c in cuts}), None]
    within = []
    for low, high in zip(bounds, bounds[1:]):
        after = F.col("ts") > F.timestamp_micros(F.lit(low)) if low is not None else F.lit(True)
        within.append(after & (F.col("ts") <= F.timestamp_micros(F.lit(high))) if high is not None else after)
    write_slices(df, within, path, files)
