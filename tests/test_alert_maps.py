"""The alert machine for parameters of any kind, and the composition of its maps."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weir.config import AlertParams, Layout
from weir.operators import alerts as A
from weir.streaming import folds

TINY = Layout(chunk=16, block=16, fan=3, ewma_block=16)


def model(risk, p):
    """One reading after the other."""
    state = warm = hot = 0
    for x in risk:
        hot = hot + 1 if x >= p.crit else 0
        warm = warm + 1 if x >= p.crit or x >= p.warn else 0
        if state == 0:
            state = 2 if hot >= p.persistence else 1 if warm >= p.persistence else 0
        elif state == 1:
            state = 2 if hot >= p.persistence else 0 if x < p.warn - p.hysteresis else 1
        elif x < p.crit - p.hysteresis:
            state = 1 if x >= p.warn else 0
        yield state


def random_params(rng):
    return AlertParams(float(rng.integers(50, 90)), float(rng.integers(50, 90)), int(rng.integers(1, 5)), float(rng.integers(-12, 15)))


def series(rng, k):
    n = int(rng.integers(1, 300))
    if k % 2:
        return rng.choice([45, 55, 60, 65, 70, 75, 80, 85, 95, np.nan], n)
    return np.clip(np.cumsum(rng.normal(0, 5, n)) + 70, 0, 100)


def test_compositions():
    table = A.compositions()
    images = [(k // 9, k // 3 % 3, k % 3) for k in range(27)]
    for a in range(27):
        for b in range(27):
            assert images[table[27 * a + b]] == tuple(images[b][s] for s in images[a])
    assert all(table[27 * (9 * 0 + 3 * 1 + 2) + k] == k == table[27 * k + 5] for k in range(27))  # 0, 1, 2 is the identity


@pytest.mark.parametrize("seed", range(6))
def test_any_parameters(spark, seed):
    rng = np.random.default_rng(seed)
    p = random_params(rng) if seed else AlertParams(80.0, 65.0, 2, 5.0)
    rows = [(f"s{k}", i, None if np.isnan(x) else float(x)) for k in range(8) for i, x in enumerate(series(rng, k))]
    got = A.alert_states_of(spark.createDataFrame(rows, "site string, seq long, risk double"), p, TINY).toPandas()
    got = got.sort_values(["site", "seq"], ignore_index=True)
    want = pd.DataFrame(rows, columns=["site", "seq", "risk"]).sort_values(["site", "seq"], ignore_index=True)
    want["level"] = [A.LEVELS[v] for _, g in want.groupby("site", sort=False) for v in model(g.risk.astype(float), p)]
    assert (got.alert_level == want.level).all()
    assert (got.alert_changed == (want.level != want.groupby("site")["level"].shift().fillna("normal"))).all()


def test_both_ways_of_composing_agree(spark):
    rng = np.random.default_rng(9)
    rows = [("s", i, *map(int, m)) for i, m in enumerate(rng.choice(3, (500, 3)))]
    regular = [r for r in rows if len(set(r[2:])) == 1 or r[3] == 1]
    df = spark.createDataFrame([(s, k, *m) for k, (s, _, *m) in enumerate(regular)], "site string, seq long, _n int, _w int, _c int")
    df = df.withColumn("_chunk", F.floor(F.col("seq") / 40))
    legal = df.filter("NOT (_n = 2 AND _w = 1)").filter("NOT (_n <> _w AND _n <> 0 AND _n <> 1)")
    one = A._running_images(legal, ["site", "_chunk"], ["seq"], "seq").select("seq", *[F.col(c).cast("int") for c in A._IMG])
    two = A._scanned_images(legal, ["site", "_chunk"], ["seq"], 40).select("seq", *A._IMG)
    assert one.count() == two.count() > 0 and one.exceptAll(two).count() == 0


def test_runs_of_any_parameters():
    rng = np.random.default_rng(11)
    for k in range(200):
        p, risk = random_params(rng), series(rng, k)
        assert folds.alert_levels(risk, p)[0].tolist() == list(model(risk, p))
