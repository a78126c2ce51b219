"""Row-level operators, rules, views, splits and files on hand-made tables."""

import pytest
from pyspark.sql import functions as F

from weir.config import LIMITS, SENSORS
from weir.functions.scoring import deviation_score
from weir.functions.text import cause_index, pretty, round_binary
from weir.operators import diagnosis as D, scenarios as N, splits as P
from weir.plans import views as V
from weir.sources import io as IO
from weir.storage import new_path


@pytest.mark.parametrize("sensor", list(LIMITS))
def test_deviation_at_the_limits(spark, sensor):
    m = LIMITS[sensor]
    values = [m.low, m.high, m.mid, m.low - m.half, m.high + m.half, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {sensor} double")
    got = [r.s for r in df.select("i", deviation_score(sensor).alias("s")).orderBy("i").collect()]
    assert got == pytest.approx([30, 30, 0, 100, 100, 0])


def test_round_binary_equals_python(spark):
    xs = [0.125, 2.675, 0.605, 1.005, -2.5, 0.5, 1.5, 7.449999, -0.125, 1234.565]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r.y for r in df.select(round_binary("x", 2).alias("y")).collect()] == [round(x, 2) for x in xs]


def test_labels(spark):
    row = spark.range(1).select(pretty(F.lit("pipe_corrosion"), 10).alias("a"), cause_index(F.lit("nope")).alias("b")).first()
    assert (row.a, row.b) == ("Pipe Corro", 0)


def test_rules_need_feature_columns_and_ignore_nulls(spark):
    df = spark.createDataFrame([(0.1, 90.0, 6.0, 250.0, 5.0, 900.0), (None, None, None, None, None, None)],
                               "chloramine double, thm double, ph double, hardness double, turbidity double, conductivity double")
    hits = [[h.cause for h in r.rule_hits] for r in D.rule_hits(df).collect()]
    assert hits == [["disinfectant_decay", "contamination_intrusion", "pipe_corrosion"], []]
    best = D.diagnose(df).select("diagnosis.*").collect()
    assert (best[0].primary_cause, best[0].confidence) == ("disinfectant_decay", 0.425)
    assert (best[1].primary_cause, best[1].confidence, best[1].all_causes) == ("normal", 1.0, [])
    assert [c.score for c in best[0].all_causes] == [0.425, 0.4, 0.375]


def test_fusion_adds_both_sides(spark):
    df = spark.createDataFrame([(0.1, 90.0)], "chloramine double, thm double")
    rule = D.rule_hits_column(df.columns)
    ml = D.ml_hits_column(F.array(*[F.lit(x) for x in (0.5, 0.3, 0.05, 0.15)]))
    out = df.select(D.fused_scores(rule, ml, 0.5, 0.5, D.CAUSES).alias("r")).first().r
    assert [(x.cause, round(x.score, 3)) for x in out] == [
        ("disinfectant_decay", 0.575), ("normal", 0.25), ("pipe_corrosion", 0.075)]


def test_blocked_split_leaves_the_rest_out(spark):
    df = spark.range(10).select(F.lit("s").alias("site"), F.col("id").alias("seq"))
    rows = P.blocked_split(df, 4).collect()
    assert max(r.seq for r in rows) == 7
    for f in (1, 2, 3):
        assert sorted(r.seq for r in rows if r.fold == f and r.role == "train") == list(range(2 * f))
        assert sorted(r.seq for r in rows if r.fold == f and r.role == "validate") == [2 * f, 2 * f + 1]


def test_scenario_is_cut_at_the_end_and_sensor_sticks(spark):
    df = spark.range(20).select(F.lit("s").alias("site"), F.col("id").alias("seq"), F.col("id").cast("double").alias("ph"),
                                F.lit("normal").alias("event_type"), F.lit(1).alias("potability"))
    sc = spark.createDataFrame([("s", 15, 50, "sensor_fault")], "site string, start_seq long, duration int, type string")
    rows = N.overlay_scenarios(df, sc).orderBy("seq").collect()
    assert [r.ph for r in rows] == [*map(float, range(15)), *[15.0] * 5]
    assert rows[19].event_type == "sensor_fault" and rows[19].potability == 1


def test_contributions_add_up_to_the_index(spark):
    df = spark.createDataFrame([("s", 0, *[float(i * 3) for i in range(9)])],
                               "site string, seq long, " + ", ".join(f"{s} double" for s in SENSORS))
    parts = V.risk_breakdown(df).agg(F.sum("contribution").alias("c"), F.sum("weight").alias("w")).first()
    score = V.score_readings(df).first()
    assert score.risk_index == pytest.approx(parts.c / parts.w)
    assert set(score.risk_breakdown) == set(SENSORS)


def test_rank_metrics_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, p double")
    row = V.rank_metrics(df, "y", "p").first()
    assert row.auc_roc == pytest.approx(0.875)


def test_raw_csv_has_nulls_for_missing_and_nan(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("Hardness,ph,Potability\n200.5,,1\nNaN,7.1,0\n")
    rows = IO.read_raw_csv(spark, str(tmp_path / "raw.csv")).collect()
    assert rows[0].asDict() == {"hardness": 200.5, "ph": None, "potability": 1} and rows[1].hardness is None


def test_partitioned_store_prunes_sites(spark):
    path = new_path(spark, "store")
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "site string, ph double")
    IO.write_readings(df, path)
    back = IO.read_readings(spark, path, ["a"])
    assert [r.ph for r in back.collect()] == [1.0]
    assert "PartitionFilters: [site" in back._jdf.queryExecution().executedPlan().toString().replace("isnotnull(site", "site")
