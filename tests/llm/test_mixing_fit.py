"""Mixing: held-out quality of the posteriors, and the rates against dense least squares."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.llm import mixing
from weir.llm.common import held_out, table, whole_text

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_posteriors_on_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), mixing.domains_of(table(spark, SF, "labels"))
    names = sorted(mixing.TARGETS)
    model = mixing.train(docs, labels.filter(~held_out()), names)
    some = docs.join(F.broadcast(labels.filter(held_out())), "doc_id").select("domain", mixing.posteriors(whole_text(), model, 3)["p"].alias("p")).toPandas()
    p, y = np.vstack(some["p"].to_numpy()), np.array([names.index(d) for d in some["domain"]])
    shares = np.bincount(y, minlength=3) / len(y)
    assert (p.argmax(1) == y).mean() >= shares.max() + 0.1
    assert np.abs(p.mean(0) - shares).max() <= 0.02


def dense(n, p, goal, steps=20000):
    """Totals of nonnegative rates nearest to ``goal`` in the metric of the operator, and that metric."""
    metric = np.linalg.pinv((p * n[:, None]).T @ p)
    a = p * n[:, None]
    r = np.ones(len(n))
    for _ in range(steps):
        r = np.maximum(0.0, r - p @ metric @ (a.T @ r - goal))
    return a.T @ r, metric


@pytest.mark.parametrize("targets,within", [([0.4, 0.35, 0.25], 1e-9), ([0.7, 0.2, 0.1], 0.05)])
def test_totals_equal_dense_least_squares(spark, targets, within):
    """Within reach of the posteriors, and (after 48 moves, from 0.97 at the first) out of their reach."""
    rng = np.random.default_rng(3)
    p = 0.85 * rng.dirichlet([0.6, 0.8, 0.7], 80) + 0.05  # no document lies in one domain alone
    n = rng.integers(1, 400, 80)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>").coalesce(1).cache()
    moves, distance = mixing.fit(members, targets, 48)
    rate = ahead = np.ones(80)
    for s in moves:
        now = np.maximum(0.0, ahead - p @ s[:3])
        rate, ahead = now, now + s[3] * (now - rate)
    goal = np.array(targets) * n.sum()
    total = (p * (n * rate)[:, None]).sum(0)
    want, metric = dense(n.astype(float), p, goal)
    far = lambda t: float((t - goal) @ metric @ (t - goal)) / n.sum()
    assert abs(np.abs(total - goal).max() / n.sum() - distance) < 1e-9
    assert far(want) - 1e-9 <= far(total) <= far(want) + within


def test_logistic_regression_has_no_gradient_left():
    rng = np.random.default_rng(1)
    x = np.hstack([np.ones((500, 1)), rng.integers(0, 2, (500, 6))]).astype(float)
    y = (x @ rng.normal(size=(7, 3)) + rng.gumbel(size=(500, 3))).argmax(1)
    w = mixing.logistic(x, y, 3)
    p = mixing.softmax_rows(x @ w)
    free = np.full(7, mixing.PENALTY)
    free[0] = 1e-6
    assert np.abs(x.T @ (p - np.eye(3)[y]) + free[:, None] * w).max() < 1e-3
    assert np.allclose(p.mean(0), np.bincount(y, minlength=3) / 500, atol=1e-4)
