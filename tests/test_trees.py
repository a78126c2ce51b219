"""Node tables against the models they come from: scores, attributions, split counts, the training run."""

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from weir.operators import features as X, splits as P
from weir.plans import models as M, trees as T
from weir.sources.fixture import readings
from weir.storage import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fitted(spark):
    feats = M.split_frame(written(X.build_features(readings(spark, SF).filter("seq < 120")), "features"))
    cols = [c for c in X.feature_columns(feats) if c.startswith(("ph", "thm", "chlor"))]
    return feats, M.train_cause(feats, cols, p=M.TreeParams(n_trees=7, max_depth=4))


def test_walks_give_the_scores_of_the_model(spark, fitted):
    feats, model = fitted
    forest = T.Forest(T.node_table(model))
    rows = model.transform(feats).select(vector_to_array("probability").alias("p"), "prediction", *forest.used).toPandas()
    x = rows[forest.used].to_numpy(float)
    got = sum(t[4][forest.walk(t, x)[0]] for t in forest.trees) / len(forest.trees)
    assert np.allclose(got, np.vstack(rows["p"].to_numpy()), atol=1e-12)
    assert forest.contributions(x, np.zeros(len(forest.used)))[0].tolist() == rows["prediction"].astype(int).tolist()


def test_attributions_equal_scoring_every_row_again(spark, fitted):
    feats, model = fitted
    some = feats.filter("site IN ('S1', 'S2') AND seq % 7 = 3")
    used = T.Forest(T.node_table(model)).used
    base = model.transform(some).select("site", "seq", F.col("prediction").cast("int").alias("c"), vector_to_array("probability").alias("p"))
    fall = {}
    for f in used:
        again = model.transform(some.withColumn(f, F.lit(model.means[f]))).select("site", "seq", vector_to_array("probability").alias("q"))
        for r in base.join(again, ["site", "seq"]).collect():
            fall.setdefault((r["site"], r["seq"]), {})[f] = r["p"][r["c"]] - r["q"][r["c"]]
    got = {}
    for r in M.cause_attribution(some, model, top_n=len(used)).collect():
        got.setdefault((r["site"], r["seq"]), []).append(r)
    assert set(got) == set(fall) and fall
    for key, rows in got.items():
        assert {r["feature"] for r in rows} == set(used)
        assert all(abs(r["contribution"] - fall[key][r["feature"]]) < 1e-4 for r in rows)
        sizes = [abs(r["contribution"]) for r in sorted(rows, key=lambda r: r["rank"])]
        assert all(a >= b - 1e-4 for a, b in zip(sizes, sizes[1:]))


def test_nodes_in_sql(spark, fitted):
    """Split counts, and every row's class probabilities, from the node table in another engine."""
    feats, model = fitted
    nodes = T.node_table(model).toPandas()
    rows = feats.select("site", "seq", *model.features).limit(40)
    want = model.transform(rows).select("site", "seq", vector_to_array("probability").alias("p")).toPandas()
    wide = rows.toPandas()
    con = duckdb.connect()
    con.register("nodes", nodes)
    con.register("long", wide.melt(["site", "seq"], var_name="feature", value_name="value"))
    counts = dict(con.execute("SELECT feature, count(*) FROM nodes WHERE feature IS NOT NULL GROUP BY feature").fetchall())
    got = {r["feature"]: r["importance"] for r in T.split_counts(T.node_table(model), model.features).collect()}
    assert got == {f: counts.get(f, 0) for f in model.features}
    shares = con.execute("""
        WITH RECURSIVE w AS (SELECT DISTINCT site, seq, tree, 0 AS node FROM long, (SELECT DISTINCT tree FROM nodes)
          UNION ALL SELECT w.site, w.seq, w.tree, CASE WHEN l.value <= n.threshold THEN n.left ELSE n.right END
          FROM w JOIN nodes n ON n.tree = w.tree AND n.node = w.node JOIN long l ON l.site = w.site AND l.seq = w.seq AND l.feature = n.feature)
        SELECT site, seq, list(list_transform(n.stats, lambda x: x / list_sum(n.stats))) AS p
        FROM w JOIN nodes n ON n.tree = w.tree AND n.node = w.node AND n.feature IS NULL GROUP BY site, seq""").fetchall()
    shares = {(s, q): np.mean(p, axis=0) for s, q, p in shares}
    assert all(np.allclose(shares[r.site, r.seq], r.p, atol=1e-12) for r in want.itertuples())


def test_targets_need_one_exchange(spark, fitted):
    frame = written(fitted[0].select("site", "pos", "ph", "thm"), "targets")
    plan = P.forecast_targets(frame, ["ph", "thm"], position="pos")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_training_run(spark, fitted, tmp_path):
    feats, _ = fitted
    keep = [c for c in X.feature_columns(feats) if c.startswith("ph")]
    models = M.train_families(feats, keep, ("ph", "thm"), M.TreeParams(max_iter=3, n_trees=3, max_depth=2), workers=3)
    M.save_families(models, str(tmp_path))
    assert set(models["forecast"]) == {"ph", "thm"}
    again = M.load_model(spark, f"{tmp_path}/forecast/thm")
    one, two = (m.transform(feats).select("site", "seq", F.round("prediction", 9)) for m in (models["forecast"]["thm"], again))
    assert one.exceptAll(two).count() == 0
    file = M.read_importance(spark, str(tmp_path)).collect()
    assert {r["feature"] for r in file} == set(keep)
    splits = T.node_table(models["potability"]).filter("feature IS NOT NULL").count()
    assert sum(r["importance"] for r in file) == splits
