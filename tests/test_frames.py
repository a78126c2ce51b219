"""Frames with gaps and offsets, joins by site, attributions, saved models, and streams with late and doubled rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weir.config import LIMITS, SENSORS
from weir.operators import alerts as A, features as X, splits as P
from weir.operators.risk import last_n
from weir.operators.sites import with_site_values
from weir.plans import models as M, views as V
from weir.shipping import ship
from weir.sources import io as IO
from weir.sources.fixture import readings
from weir.storage import new_path, written
from weir.streaming import series as ST

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frame(spark):
    ship(spark)
    return written(readings(spark, SF), "readings")


def test_no_plan_deals_readings_by_site_alone(spark, frame):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (last_n(frame, 50), P.ordered_split(frame), P.blocked_split(frame), V.first_n(frame, 5)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            for part in plan.split("SortMergeJoin")[1:]:
                assert part.strip().startswith("[site") and "_salt" in part.split("\n")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_site_values(spark):
    rows = spark.createDataFrame([("a", i) for i in range(2000)] + [("b", 5)], "site string, seq long")
    values = spark.createDataFrame([("a", 1), ("c", 2)], "site string, v int")
    assert with_site_values(rows, values).count() == 2000
    assert with_site_values(rows, values, how="left").filter("v IS NULL").collect() == [("b", 5, None)]


def test_positions_with_gaps_are_refused(frame):
    with pytest.raises(ValueError):
        X.add_lags(frame.filter("seq <> 7"))


def test_slice_equals_a_series_of_its_own(frame):
    cut = frame.filter("seq >= 37")
    fresh = cut.withColumn("seq", F.col("seq") - 37)
    names = [f"{s}_lag3" for s in SENSORS] + [f"{s}_ewma_6" for s in SENSORS] + ["ph_w36_mean"]
    a = X.all_features(cut).withColumn("seq", F.col("seq") - 37).select("site", "seq", *names)
    b = X.all_features(fresh).select("site", "seq", *names)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_splits_count_rows_of_the_frame(spark):
    rows = [("a", i) for i in range(40) if i % 3] + [("b", i) for i in range(9)]
    numbered = P.frame_positions(spark.createDataFrame(rows, "site string, seq long"))
    got = {(r.site, r.seq): r.role for r in P.ordered_split(numbered, position="pos").collect()}
    a = sorted(s for k, s in got if k == "a")
    assert [got["a", s] for s in a] == ["train"] * (len(a) * 3 // 4) + ["validate"] * (len(a) - len(a) * 3 // 4)
    folds = P.blocked_split(numbered, position="pos").filter("site = 'a' AND fold = 2 AND role = 'validate'")
    block = len(a) // 4
    assert sorted(r.seq for r in folds.collect()) == a[2 * block:3 * block]
    target = {r.seq: r.target for r in P.forecast_target(numbered.filter("site = 'a'").withColumn("x", F.col("seq") * 10), "x", 4, position="pos").collect()}
    assert target == {s: 10 * a[i + 4] for i, s in enumerate(a[:-4])}


def test_cells_that_are_no_numbers(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("ph,Hardness,Potability\n7.1,N/A,1\n,200.5,x\n")
    got = IO.read_raw_csv(spark, str(path))
    assert sorted((r.ph is None, r.ph) for r in got.select("ph").collect()) == [(False, 7.1), (True, None)]
    assert got.filter("potability IS NULL").count() == 1


@pytest.fixture(scope="module")
def model(spark, frame):
    feats = M.split_frame(written(X.build_features(frame), "features"))
    cols = [c for c in X.feature_columns(feats) if c.startswith(("ph", "thm"))]
    return feats, M.train_cause(feats, cols, p=M.TreeParams(n_trees=5, max_depth=4))


def test_attribution_does_not_depend_on_the_other_rows(spark, model):
    feats, fitted = model
    some = feats.filter("site = 'S1' AND seq BETWEEN 20 AND 30")
    among = {tuple(r) for r in M.cause_attribution(some, fitted).filter("seq = 25").collect()}
    alone = {tuple(r) for r in M.cause_attribution(some.filter("seq = 25"), fitted).collect()}
    assert among == alone and len(alone) > 0
    told = M.diagnose_with_attribution(some, fitted).filter("seq = 25").select("diagnosis.feature_contributions").first()[0]
    assert [c.feature for c in told] == [r[4] for r in sorted(alone, key=lambda r: r[3])]


def test_saved_models_say_the_same(spark, model):
    feats, fitted = model
    path = new_path(spark, "model")
    M.save_model(fitted, path)
    again = M.load_model(spark, path)
    assert again.means == fitted.means and again.features == fitted.features and again.classes == fitted.classes
    assert M.load_model(spark, path + "-none") is None
    a = M.with_predicted_cause(fitted, feats).select("site", "seq", "predicted_cause")
    assert a.exceptAll(M.with_predicted_cause(again, feats).select("site", "seq", "predicted_cause")).count() == 0


def test_stream_with_late_and_doubled_rows(spark, tmp_path):
    """Two files: the second brings a doubled reading, one inside the delay, and one far too late."""
    ship(spark)
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    mids = {s: (lim.low + lim.high) / 2 for s, lim in LIMITS.items()}
    row = lambda i, bad=False: ("a", start + dt.timedelta(minutes=5 * i), *[
        mids[s] * (3 if bad else 1) + rng.random() if s in mids else 1.0 for s in SENSORS])
    schema = "site string, ts timestamp, " + ", ".join(f"{s} double" for s in SENSORS)
    rows = [row(i, 30 <= i < 60) for i in range(100)]
    folder = str(tmp_path / "in")
    for part in (rows[:50] + rows[51:55], [rows[50], rows[40], rows[52], row(2)] + rows[55:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = ST.alert_stream(stream, str(tmp_path / "out"), delay="1 hour", dedupe=True)
    unique = spark.createDataFrame(rows, schema)
    want = A.alert_states(IO.ingest(unique)).select("site", "ts", F.round("risk", 6).alias("risk"), "alert_level")
    have = got.select("site", "ts", F.round("risk", 6).alias("risk"), "alert_level")
    assert have.count() == 100 and have.exceptAll(want).count() == 0
