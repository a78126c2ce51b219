"""Streams against the batch operators and a sequential model: late and doubled readings, restarts, replay order."""

import datetime as dt
import glob
import random

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weir.config import LIMITS, SENSORS, AlertParams
from weir.operators import alerts as A, features as X
from weir.shipping import ship
from weir.sources import io as IO
from weir.streaming import folds, scoring as SS, series as ST

START = dt.datetime(2024, 1, 1)
SCHEMA = "site string, ts timestamp, " + ", ".join(f"{s} double" for s in SENSORS)


@pytest.fixture(autouse=True)
def sources(spark):
    ship(spark)


def made(rng, site, n, nulls=0.1):
    mid = {s: (lim.low + lim.high) / 2 for s, lim in LIMITS.items()}
    bad = 1.0
    for i in range(n):
        bad = rng.choice([1.0, 2.0, 3.0]) if rng.random() < 0.1 else bad
        yield (site, START + dt.timedelta(minutes=5 * i), *[None if rng.random() < nulls else mid.get(s, 1.0) * bad + rng.random() for s in SENSORS])


def sequential_levels(risk, p, level=0, over_warn=0, over_crit=0):
    out = []
    for x in risk:
        over_crit = over_crit + 1 if x >= p.crit else 0
        over_warn = over_warn + 1 if x >= p.crit or x >= p.warn else 0
        if level == 2:
            level = 2 if x >= p.crit - p.hysteresis else 1 if x >= p.warn else 0
        elif over_crit >= p.persistence:
            level = 2
        elif level == 0:
            level = 1 if over_warn >= p.persistence else 0
        elif x < p.warn - p.hysteresis:
            level = 0
        out.append(level)
    return out, over_warn, over_crit


def test_levels_of_runs():
    rng = np.random.default_rng(2)
    for _ in range(300):
        p = AlertParams(float(rng.integers(40, 80)), 80.0, int(rng.integers(1, 5)), float(rng.integers(0, 15)))
        risk = np.clip(60 + np.cumsum(rng.normal(0, 8, int(rng.integers(1, 80)))), 0, 100)
        enter = (int(rng.integers(0, 3)), int(rng.integers(0, 4)), 0)
        enter = (enter[0], enter[1], int(rng.integers(0, enter[1] + 1)))
        levels, warm, hot = folds.alert_levels(risk, p, *enter)
        want, w, h = sequential_levels(risk, p, *enter)
        assert levels.tolist() == want and (warm, hot) == (w, h)


@pytest.mark.parametrize("cuts", [(), (1, 2, 5, 40, 41, 100), tuple(range(1, 130, 7))])
def test_features_of_runs_equal_the_batch(spark, cuts):
    rng = random.Random(len(cuts))
    rows = list(made(rng, "a", 130, 0.3))
    rows = [r[:2] + tuple(None if 20 < i < 110 and s == "ph" else v for s, v in zip(SENSORS, r[2:])) for i, r in enumerate(rows)]
    frame = pd.DataFrame([r[2:] for r in rows], columns=list(SENSORS), dtype=float)
    fold, state, tail, parts = folds.FeatureFold(), folds.FeatureFold().start, np.empty((0, len(SENSORS))), []
    for low, high in zip((0, *cuts), (*cuts, 130)):
        state, out = fold(state, frame.iloc[low:high], tail, frame.iloc[high:])
        tail = np.vstack([tail, frame.iloc[low:high].to_numpy()])[-fold.tail:]
        parts.append(pd.DataFrame(out))
    got = pd.concat(parts, ignore_index=True)
    want = X.all_features(IO.ingest(spark.createDataFrame(rows, SCHEMA))).toPandas().sort_values("seq", ignore_index=True)
    assert got["seq"].tolist() == want["seq"].tolist()
    for c in got.columns:
        assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float), atol=1e-9, equal_nan=True), c


def write(spark, folder, parts):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def batch_levels(spark, rows):
    done = A.alert_states(IO.ingest(spark.createDataFrame(rows, SCHEMA)))
    return done.select("site", "ts", "seq", F.round("risk", 6).alias("risk"), "alert_level", "alert_changed")


def test_a_stopped_query_goes_on_from_its_state(spark, tmp_path):
    """The query is stopped in the middle and started again twice, the second time with further input."""
    rng = random.Random(4)
    rows = [r for s in ("a", "b") for r in made(rng, s, 160)]
    late = [r for r in rows if r[1] >= START + dt.timedelta(minutes=600)]
    first = [r for r in rows if r not in late]
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    rng.shuffle(first)
    first.sort(key=lambda r: r[1] + dt.timedelta(minutes=rng.random() * 50))  # out of order within the delay
    write(spark, folder, [first[i:i + 60] for i in range(0, len(first), 60)])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    table = ST.alerts_in_order(stream, delay="1 hour", ends=ST.end_marks(spark, path))
    query = ST.start_to_table(table, f"{path}/out", f"{path}/progress", now=False)
    while query.isActive and (query.lastProgress is None or query.lastProgress["batchId"] < 1):
        query.awaitTermination(1)
    query.stop()
    open_part = ST.alert_stream(stream, path, flush=False)
    assert 0 < open_part.count() < len(rows)
    write(spark, folder, [late])
    got = ST.alert_stream(stream, path).select("site", "ts", "seq", F.round("risk", 6).alias("risk"), "alert_level", "alert_changed")
    want = batch_levels(spark, rows)
    assert got.count() == want.count() == len(rows) and got.exceptAll(want).count() == 0
    state = spark.read.format("statestore").option("stateVarName", "known").load(f"{path}/progress")
    assert state.count() == 2  # kept by the engine: one value per site


def test_what_is_behind_the_watermark_is_dropped(spark, tmp_path):
    """A reading two batches behind the watermark goes, one inside the delay stays, a doubled one counts once."""
    rng = random.Random(5)
    rows = list(made(rng, "a", 100))
    folder = str(tmp_path / "in")
    held = (10, 50, 55)
    write(spark, folder, [[r for i, r in enumerate(rows[:60]) if i not in held], rows[60:70] + [rows[50]], rows[70:] + [rows[10], rows[65], rows[66]]])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    got = ST.alert_stream(stream, str(tmp_path / "out"), dedupe=True)
    want = batch_levels(spark, [r for i, r in enumerate(rows) if i not in (10, 55)])
    have = got.select("site", "ts", "seq", F.round("risk", 6).alias("risk"), "alert_level", "alert_changed")
    assert have.count() == 98 and have.exceptAll(want).count() == 0


def test_replay_in_slices_of_even_files(spark, tmp_path):
    rows = spark.range(20_000).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"), "id").repartition(7)
    path = str(tmp_path / "replay")
    SS.write_in_time_order(rows, path, 5, 4)
    files = sorted(glob.glob(f"{path}/*.parquet"), key=lambda f: __import__("os").stat(f).st_mtime_ns)
    assert len(files) == 20
    read = [pq.read_table(f)["id"].to_pylist() for f in files]
    sizes = sorted(map(len, read))
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]
    slices = [sum(read[i:i + 4], []) for i in range(0, 20, 4)]
    assert all(max(a) < min(b) for a, b in zip(slices, slices[1:])) and sum(map(len, slices)) == 20_000


def test_runs_are_folded_in_pieces(spark, tmp_path, monkeypatch):
    """What one batch releases leaves in pieces, and is the same as in one; back-fills look beyond a piece."""
    rng = random.Random(6)
    rows = [tuple(None if 30 < i < 100 and s == "ph" or i > 110 and s == "thm" else v for s, v in zip(("site", "ts", *SENSORS), r)) for i, r in enumerate(made(rng, "a", 130, 0.3))]
    frame = pd.DataFrame([r[2:] for r in rows], columns=list(SENSORS), dtype=float)
    frame["us"] = np.arange(len(frame))
    fold = folds.FeatureFold()
    whole = pd.DataFrame(fold(fold.start, frame, np.empty((0, len(SENSORS))), frame.iloc[:0])[1])

    class Held:
        """A state value, or list, of one site."""
        def __init__(self): self.it = None
        def exists(self): return self.it is not None
        def get(self): return self.it
        def update(self, it): self.it = it
        put = update
        def clear(self): self.it = None
        def appendValue(self, v): self.it = [*(self.it or []), v]

    class Handle:
        def registerTimer(self, ms): pass

    class Times:
        def getCurrentWatermarkInMs(self): return 10

    for piece in (7, 8192):
        monkeypatch.setattr(ST, "PIECE", piece)
        p = ST.InOrder(fold, (), ["us"])
        p.handle, p.waiting, p.earliest, p.known, p.tail = Handle(), Held(), Held(), Held(), Held()
        for part in (frame.iloc[60:], frame.iloc[:60]):
            assert list(p.handleInputRows(("a",), iter([part.assign(is_end=False, ts=0)]), Times())) == []
        out = list(p.handleExpiredTimer(("a",), Times(), None))
        assert max(map(len, out)) <= piece and not p.waiting.exists()
        got = pd.concat(out, ignore_index=True)
        assert got["seq"].tolist() == list(range(130)) and p.known.get()[0] == 130
        for c in whole.columns:
            assert np.allclose(got[c].to_numpy(float), whole[c].to_numpy(float), atol=1e-9, equal_nan=True), c
