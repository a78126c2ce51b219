"""Positions, roles and targets found on the readings' own columns, and models fitted only where a query needs them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weir import storage
from weir.config import SENSORS
from weir.operators import features as X, splits as P
from weir.plans import models as M, registry as R
from weir.shipping import ship
from weir.sources import io as IO

SCHEMA = "site string, ts timestamp, " + ", ".join(f"{s} double" for s in SENSORS) + ", potability int, event_type string"


def made(seed, odd=()):
    """Two sites with nulls in every column but the site, a dead sensor at the end of one, and zeros."""
    rng = random.Random(seed)
    rows = []
    for site, n in (("a", 150), ("b", 90)):
        for i in range(n):
            values = [None if rng.random() < 0.02 or (site == "b" and s == "thm" and i > 70) else rng.choice([0.0, -0.01, rng.random()]) for s in SENSORS]
            rows.append((site, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=5 * i), *values, None if rng.random() < 0.05 else i % 2, "normal"))
    for at, value in odd:
        rows[at] = (*rows[at][:2], value, *rows[at][3:])
    return rows


@pytest.fixture
def numbered(spark):
    ship(spark)
    return lambda rows: storage.written(IO.ingest(spark.createDataFrame(rows, SCHEMA)), "readings")


@pytest.mark.parametrize("value", [None, float("nan")])
def test_kept_rows_are_those_of_the_feature_frame(spark, numbered, value):
    frame = numbered(made(3))
    if value is not None:  # NaN spreads to the rows whose windows hold it
        frame = storage.written(frame.withColumn("ph", F.when(F.col("seq") == 40, F.lit(value)).otherwise(F.col("ph"))), "odd")
    want = X.build_features(frame).select(*frame.columns)
    got = X.kept_rows(frame)
    assert 0 < got.count() < frame.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_placed_rows_equal_the_split_of_the_feature_frame(spark, numbered, monkeypatch):
    frame, wide = numbered(made(4)), []
    kept = M.written
    monkeypatch.setattr(M, "written", lambda df, name: (wide.append(len(df.columns)), kept(df, name))[1])
    rows = M.placed(frame)
    assert max(wide) < 40  # no table of features for what needs none
    feats = M.placed_features(rows)
    want = M.split_frame(kept(X.build_features(frame), "features"))
    cols = [c for c in want.columns]
    assert set(X.feature_columns(feats)) == set(X.feature_columns(want))
    narrow = ["site", "seq", "pos", "role", *[f"target_{s}" for s in SENSORS]]
    for a, b, names in ((M.in_frame(rows), want, narrow), (feats, want, cols)):
        a, b = a.select(names), b.select(names)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("n", [4])
def test_a_fold_by_rows_is_that_of_the_split(spark, numbered, n):
    rows = M.in_frame(M.placed(numbered(made(5))))
    folds = P.blocked_split(rows.drop("role"), n, position="pos").select("site", "pos", "fold", "role")
    for f in range(1, n):
        a, b = P.fold_rows(rows, f, n).select("site", "pos", "fold", "role"), folds.filter(F.col("fold") == f)
        assert a.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_a_query_fits_only_its_family(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(R, "split_frame", lambda spark, sf: None)
    monkeypatch.setattr(R, "_stamped", lambda spark, sf, name: ("test-family", name))
    monkeypatch.setattr(M, "train_families", lambda frame, families=M.FAMILIES: asked.append(families) or {f: f for f in families})
    assert (R._cause(spark, "-"), R._potability(spark, "-"), R._cause(spark, "-")) == ("cause", "potability", "cause")
    assert asked == [("cause",), ("potability",)]


def test_forecasts_share_a_vector(spark, numbered):
    rows = M.in_frame(M.placed(numbered(made(6))))
    models = M.train_families(rows, ["ph", "tds"], ("ph", "thm"), M.TreeParams(max_iter=2, max_depth=2), families=("forecast",))["forecast"]
    assert list(models) == ["ph", "thm"]
    got = M.with_forecasts(models, rows)
    for s, m in models.items():
        want = m.transform(rows).select("site", "seq", F.col("prediction").alias(f"_f_{s}"))
        assert got.select("site", "seq", f"_f_{s}").exceptAll(want).count() == 0
    mae = {r.sensor: (r.n_rows, round(r.mae, 9)) for r in M.forecast_mae(models, rows).collect()}
    for s in models:
        held = got.filter(f"role = 'validate' AND target_{s} IS NOT NULL").select(F.abs(F.col(f"target_{s}") - F.col(f"_f_{s}"))).toPandas().iloc[:, 0]
        assert mae[s] == (len(held), round(held.mean(), 9))
