"""Series operators on a stream: smoothed risk, alert levels and all window features.

State is Spark's: ``transformWithStateInPandas`` keeps, per site, the readings that wait for
the watermark, the sums, counters and level the fold goes on from, and the last readings it
looks back on. Spark drops what comes behind the watermark, forgets doubled readings within it,
versions the state with the checkpoint, and wakes a site with an event-time timer when the
watermark has passed its earliest waiting reading. Released readings leave in event-time order
and are numbered on.

A site's readings of one micro-batch pass one task, as their order demands; what that can be
is bounded by the rate the source admits per trigger, not by the site's history. Work per
reading is numpy on runs of ``PIECE`` readings (:mod:`weir.streaming.folds`), whose results
leave before the next run is folded, and only the columns a fold needs travel to it.

The back-fill of a lag takes the next reading that has arrived when the row is released, and
is null where none has.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import RISK_SPAN, SENSORS, AlertParams
from ..functions.calendar import time_encodings
from ..functions.scoring import risk_raw
from ..operators.features import present, ratio_exprs
from .folds import AlertFold, FeatureFold

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The end of a finished stream: later than any reading.
END = "2200-01-01"
#: Readings of a site that are folded, and kept waiting in one entry, at once.
PIECE = 8192


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class InOrder(StatefulProcessor):
    """Holds a site's readings until the watermark passes them, then folds them in ``order``."""

    def __init__(self, fold, order: tuple[str, ...], carried: list[str]):
        self.fold, self.order, self.carried = fold, list(order), carried

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "first_us long, rows binary")  # one entry per batch of arrivals
        self.earliest = handle.getValueState("earliest", "us long")
        self.known = handle.getValueState("known", self.fold.state)
        self.tail = handle.getListState("tail", "values array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for f in rows:
            fresh = f[~f["is_end"]].drop(columns=["is_end", "ts"])
            if len(fresh):
                at = int(fresh["us"].min())
                self.waiting.appendValue((at, _packed(fresh)))
                first = at if first is None else min(first, at)
        if first is not None:
            self._wake(min(first, self.earliest.get()[0]) if self.earliest.exists() else first)
        return iter(())

    def _wake(self, first: int) -> None:
        self.earliest.update((first,))
        self.handle.registerTimer(-(-first // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        if not self.earliest.exists() or self.earliest.get()[0] > reached:
            return  # an earlier timer of this site has released its readings
        rows = pd.concat([_unpacked(data) for _, data in self.waiting.get()], ignore_index=True)
        rows = rows.sort_values(["us", *self.order], kind="stable", ignore_index=True)
        n = int(np.searchsorted(rows["us"].to_numpy(), reached, side="right"))
        if n < len(rows):
            cuts = range(n, len(rows), PIECE)
            self.waiting.put([(int(rows["us"].iloc[at]), _packed(rows.iloc[at:at + PIECE])) for at in cuts])
            self._wake(int(rows["us"].iloc[n]))
        else:
            self.waiting.clear()
            self.earliest.clear()
        keep = self.fold.tail
        tail = np.array([v for (v,) in self.tail.get()], float) if keep and self.tail.exists() else None
        tail = np.empty((0, len(self.fold.sensors) if keep else 0)) if tail is None else tail
        state, sight = self.known.get() if self.known.exists() else self.fold.start, self.fold.sight(rows)
        for at in range(0, n, PIECE):  # what a run becomes may be many times its size
            end = min(at + PIECE, n)
            ready = rows.iloc[at:end]
            state, made = self.fold(state, ready, tail, rows.iloc[end:sight(end)])
            if keep:
                tail = np.vstack([tail, ready[list(self.fold.sensors)].to_numpy(float)[-keep:]])[-keep:]
            yield pd.DataFrame({"site": np.full(end - at, key[0], object), **{c: ready[c].to_numpy() for c in self.carried}, **made})
        self.known.update(state)
        if keep:
            self.tail.put([(v,) for v in tail.tolist()])

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, fold, delay: str = "1 hour", dedupe: bool = False, order: tuple[str, ...] = ("ts",),
             carried: tuple[str, ...] = (), ends: DataFrame | None = None) -> DataFrame:
    """A streaming table with site, ts, the ``carried`` columns and what ``fold`` makes of each reading.
    ``ends`` is a stream of times that no later reading undercuts; such a time moves the watermark
    without being a reading."""
    ties = tuple(c for c in order if c != "ts")
    kept = list(dict.fromkeys(("us", *ties, *carried)))
    needed = [c for c in dict.fromkeys((*kept, *getattr(fold, "sensors", ("risk_raw",))))]
    rows = stream.withColumns({"us": F.unix_micros("ts"), "is_end": F.lit(False)}).select("site", "ts", "is_end", *needed)
    if ends is not None:
        types = dict(rows.dtypes)
        marks = ends.select(F.lit(None).cast("string").alias("site"), F.col("ts"), F.lit(True).alias("is_end"),
                            *[F.lit(None).cast(types[c]).alias(c) for c in needed])
        rows = rows.unionByName(marks)
    rows = rows.withWatermark("ts", delay)
    if dedupe:
        rows = rows.dropDuplicatesWithinWatermark(["site", "ts", *ties])
    types = dict(rows.dtypes)
    schema = f"site string, {', '.join(f'`{c}` {types[c]}' for c in kept)}, {fold.made}"
    out = rows.groupBy("site").transformWithStateInPandas(InOrder(fold, ties, kept), outputStructType=schema, outputMode="append", timeMode="EventTime")
    return out.withColumn("ts", F.timestamp_micros("us")).drop("us")


def alerts_in_order(stream: DataFrame, params: AlertParams = AlertParams(), span: int = RISK_SPAN, **how) -> DataFrame:
    """Streaming table with the smoothed risk and alert level of every reading."""
    scored = stream.withColumn("risk_raw", risk_raw(stream.columns))  # one number per reading goes to the fold
    out = in_order(scored, AlertFold(params, span), **how)
    return out.select("site", "seq", "ts", *how.get("carried", ()), "risk", "alert_level", "alert_changed")


def features_in_order(stream: DataFrame, **how) -> DataFrame:
    """Streaming table with all features of every reading, and the readings' own columns."""
    fold = FeatureFold(tuple(present(stream, SENSORS)))
    own = [c for c in stream.columns if c not in ("site", "ts", "seq")]
    out = in_order(stream, fold, carried=tuple(own), **how)
    return out.select("*", *[c.alias(n) for n, c in time_encodings("ts").items()], *[F.expr(e) for e in ratio_exprs(out.columns)])


# ---------------------------------------------------------------- running

@contextmanager
def state_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, whose size is not bound by memory."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def end_marks(spark: SparkSession, path: str) -> DataFrame:
    """A stream of end marks, none at first."""
    folder = f"{path}/ends"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    return spark.readStream.schema("ts timestamp").parquet(folder)


def mark_end(spark: SparkSession, path: str, end: str = END) -> None:
    spark.range(1).select(F.lit(end).cast("timestamp").alias("ts")).write.mode("append").parquet(f"{path}/ends")


def start_to_table(stream: DataFrame, path: str, checkpoint: str, now: bool = True) -> StreamingQuery:
    out = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    with state_store(stream.sparkSession):
        return (out.trigger(availableNow=True) if now else out).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drain what the source holds now into a parquet table and return it."""
    start_to_table(stream, path, checkpoint).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def _drained(stream: DataFrame, make, path: str, flush: bool) -> DataFrame:
    """Run the table that ``make(ends)`` gives; with ``flush`` the input is over, and what still waits is
    released. ``path`` keeps results, state and progress, so a later call goes on from there."""
    spark = stream.sparkSession
    table = make(end_marks(spark, path))
    out = run_to_table(table, f"{path}/out", f"{path}/progress")
    if flush:
        mark_end(spark, path)
        out = run_to_table(table, f"{path}/out", f"{path}/progress")
    return out


def alert_stream(stream: DataFrame, path: str, params: AlertParams = AlertParams(), span: int = RISK_SPAN, delay: str = "1 hour",
                 dedupe: bool = False, flush: bool = True, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Smoothed risk and alert level of every reading the source holds now."""
    return _drained(stream, lambda ends: alerts_in_order(stream, params, span, delay=delay, dedupe=dedupe, order=order, ends=ends), path, flush)


def feature_stream(stream: DataFrame, path: str, delay: str = "1 hour", dedupe: bool = False, flush: bool = True,
                   order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """All features of every reading the source holds now."""
    return _drained(stream, lambda ends: features_in_order(stream, delay=delay, dedupe=dedupe, order=order, ends=ends), path, flush)
