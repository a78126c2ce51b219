"""Numbering, windows and alerts against simple sequential models, with chunks so small
that every series crosses many of them."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weir.config import SENSORS, AlertParams, Layout
from weir.operators import alerts as A, features as X, risk as R
from weir.sources.numbering import number_series
from weir.storage import written

SMALL = Layout(chunk=512, block=256, fan=2, ewma_block=128)
TINY = Layout(chunk=16, block=16, fan=3, ewma_block=16)


def frame(spark, columns: dict, schema=None):
    return spark.createDataFrame(pd.DataFrame(columns).replace({np.nan: None}), schema)


def test_numbering_of_a_site_with_most_rows(spark):
    rng = np.random.default_rng(0)
    n = 4000
    site = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    pdf = pd.DataFrame({"site": site, "ts": rng.permutation(n)})
    got = number_series(spark.createDataFrame(pdf).repartition(7), order=("ts",), partitions=13).toPandas()
    want = pdf.sort_values(["site", "ts"]).assign(seq=lambda d: d.groupby("site").cumcount())
    merged = got.merge(want, on=["site", "ts"], suffixes=("", "_want"))
    assert len(merged) == n and (merged.seq == merged.seq_want).all()


def expected(v: pd.Series, s: str) -> dict:
    out = {}
    for w in (6, 12, 36, 72):
        r = v.rolling(w, min_periods=1)
        std = r.apply(lambda a: np.nanstd(a, ddof=1) if (~np.isnan(a)).sum() > 1 else 0.0, raw=True).fillna(0)
        out.update({f"{s}_w{w}_mean": r.mean(), f"{s}_w{w}_std": std, f"{s}_w{w}_min": r.min(),
                    f"{s}_w{w}_max": r.max(), f"{s}_w{w}_range": r.max() - r.min()})
    for k in (6, 24):
        out[f"{s}_ewma_{k}"] = v.ewm(span=k, min_periods=1).mean()
    for k in (1, 3):
        out[f"{s}_diff{k}"] = v.diff(k).fillna(0)
    for k in (1, 3, 6, 12):
        out[f"{s}_lag{k}"] = v.shift(k).bfill()
    out[f"{s}_stuck"] = (out[f"{s}_w12_std"] < 1e-6).astype(int)
    return out


def test_features_with_null_runs_longer_than_chunks(spark):
    rng = np.random.default_rng(1)
    parts = []
    for site, n in (("long", 2300), ("short", 5), ("one", 1), ("mid", 700)):
        d = pd.DataFrame({"site": site, "seq": np.arange(n), "ph": rng.normal(7, 1, n), "tds": rng.normal(300, 50, n),
                          "thm": np.nan, "sulfate": rng.normal(100, 9, n), "hardness": 5.0, "turbidity": rng.normal(2, 1, n)})
        d.loc[(d.seq >= 300) & (d.seq < 1900) | (d.seq < 3), "ph"] = np.nan
        d.loc[d.seq < 1000, "tds"] = np.nan
        d.loc[d.seq != 700 % n, "sulfate"] = np.nan
        d.loc[rng.random(n) < 0.6, "turbidity"] = np.nan
        parts.append(d)
    pdf = pd.concat(parts)
    sensors = ["ph", "tds", "thm", "sulfate", "hardness", "turbidity"]
    df = written(frame(spark, pdf, "site string, seq long, " + ", ".join(f"{s} double" for s in
                       ("ph", "tds", "thm", "sulfate", "hardness", "turbidity"))), "t")
    got = X.all_features(df, layout=SMALL).toPandas().sort_values(["site", "seq"])
    assert len(got) == len(pdf)
    for site, g in got.groupby("site"):
        for s in sensors:
            for name, want in expected(g[s].astype(float), s).items():
                have = g[name].astype(float)
                assert (have.isna() == want.isna()).all(), (site, name)
                assert np.allclose(have.fillna(0), want.fillna(0), rtol=1e-9, atol=1e-9), (site, name)


def sequential(xs, p):
    state = warm = hot = 0
    for x in xs:
        hot = hot + 1 if x >= p.crit else 0
        warm = warm + 1 if x >= p.warn else 0
        if state == 0:
            state = 2 if hot >= p.persistence else 1 if warm >= p.persistence else 0
        elif state == 1:
            state = 2 if hot >= p.persistence else 0 if x < p.warn - p.hysteresis else 1
        elif x < p.crit - p.hysteresis:
            state = 1 if x >= p.warn else 0
        yield A.LEVELS[state]


@pytest.mark.parametrize("p", [AlertParams(), AlertParams(65, 68, 2, 6), AlertParams(64, 78, 4, 8)])
def test_alert_machine_equals_sequential_model(spark, p):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(30):
        n = int(rng.integers(1, 500))
        if k % 3 == 0:
            x = rng.choice([50, 60, 62, 64.9, 65, 70, 74, 75, 78, 80, 90, np.nan], n)
        elif k % 3 == 1:
            x = rng.choice([76, 77, 78, 79, 61, 63], n, p=[.4, .3, .15, .1, .03, .02])
        else:
            x = np.clip(np.cumsum(rng.normal(0, 3, n)) + 70, 0, 100)
        rows += [(f"s{k}", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "site string, seq long, risk double")
    got = A.alert_states_of(df, p, TINY).toPandas().sort_values(["site", "seq"]).reset_index(drop=True)
    want = pd.DataFrame(rows, columns=["site", "seq", "risk"]).sort_values(["site", "seq"]).reset_index(drop=True)
    want["level"] = [v for _, g in want.groupby("site", sort=False) for v in sequential(g.risk, p)]
    before = want.groupby("site")["level"].shift().fillna("normal")
    assert (got.alert_level == want.level).all()
    assert (got.alert_changed == (want.level != before)).all()


@pytest.mark.parametrize("xs,last", [
    ([65, 80, 80], "warning"), ([65, 80, 80, 80], "critical"), ([90] * 3 + [74], "warning"),
    ([90] * 3 + [64], "normal"), ([70] * 3 + [62], "warning"), ([70] * 3 + [60], "warning"),
    ([70] * 3 + [59.9], "normal"), ([90] * 3 + [75], "critical"), ([70, 70, None, 70], "normal")])
def test_alert_edges(spark, xs, last):
    df = spark.createDataFrame([("s", i, None if x is None else float(x)) for i, x in enumerate(xs)],
                               "site string, seq long, risk double")
    rows = A.alert_states_of(df, layout=TINY).orderBy("seq").collect()
    assert rows[-1].alert_level == last


def test_risk_of_empty_null_and_missing(spark):
    schema = "site string, seq long, ts timestamp, event_type string, " + ", ".join(f"{s} double" for s in SENSORS)
    empty = spark.createDataFrame([], schema)
    assert R.risk_series(empty).count() == 0
    assert A.alert_states(empty).count() == 0
    nulls = spark.createDataFrame([("s", 0, dt.datetime(2024, 1, 1), "normal", *[None] * 9)], schema)
    assert R.risk_series(nulls).first().risk == 0.0
    part = spark.createDataFrame([("s", 0, 7.5, 10.0)], "site string, seq long, ph double, turbidity double")
    assert R.risk_series(part).first().risk == pytest.approx((0.12 * 0 + 0.20 * 100) / 0.32)


def test_one_exchange_for_all_window_features(spark):
    df = spark.range(100).select(F.lit("s").alias("site"), F.col("id").alias("seq"), *[F.lit(1.0).alias(s) for s in SENSORS])
    plan = X.all_features(written(df, "t"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
