"""Named queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import DIFFS, LAGS, LIMITS, RAW_TO_SENSOR, SENSORS, SPANS
from ..functions.calendar import add_time_encodings
from ..functions.scoring import deviation_score, risk_level, risk_raw
from ..operators import alerts as A, diagnosis as D, features as X, quality as Q, risk as R, scenarios as N, splits as P
from ..sources.fixture import as_measured, measured_events, measured_readings, readings
from ..sources import io as IO
from ..storage import new_path, once, remembered, stamp, written
from ..streaming import scoring as SS, series as ST
from . import models as M, surface as SQL, views as V

IDS = ("site", "seq")


def rounded(df: DataFrame, cols=None, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison across engines."""
    names = cols or [c for c, t in df.dtypes if t == "double"]
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def single(df: DataFrame) -> DataFrame:
    """Doubles at single precision: values made of few-digit numbers often lie between two decimals."""
    return df.select(*[F.col(c).cast("float").cast("double").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def shown(df: DataFrame) -> DataFrame:
    """As :func:`rounded`, but rolling means at single precision: means of few-digit values
    often lie exactly between two 6-digit decimals."""
    means = [c for c in df.columns if c.endswith("_mean")]
    out = rounded(df, [c for c, t in df.dtypes if t == "double" and c not in means])
    return out.select(*[F.col(c).cast("float").cast("double").alias(c) if c in means else F.col(c) for c in out.columns])


def _stamped(spark: SparkSession, sf: str, name: str, table: str = "events") -> tuple:
    """A key that follows the table's files, so that what was made of an earlier state is not used again."""
    return name, sf, stamp(spark, f"{sf}/{table}.parquet")


def alert_table(spark: SparkSession, sf: str) -> DataFrame:
    """Alert levels of all readings, written once per application."""
    return once(spark, _stamped(spark, sf, "alerts"), lambda: A.alert_states(readings(spark, sf), keep=["ts", "event_type"]))


def rule_frame(spark: SparkSession, sf: str) -> DataFrame:
    return D.rule_feature_frame(readings(spark, sf))


def scenario_table(r: DataFrame) -> DataFrame:
    """A scenario at every 97th reading, its type in turn; long ones overlap the next."""
    kind = F.array(*[F.lit(t) for t in N.TYPES])
    length = F.array(*[F.lit(N.DURATIONS[t]) for t in N.TYPES])
    turn = F.floor(F.col("seq") / 97) % 5
    return r.filter("seq % 97 = 31").select("site", F.col("seq").alias("start_seq"), F.get(kind, turn.cast("int")).alias("type"),
                                            F.get(length, turn.cast("int")).alias("duration"))


def _readings_query(f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: f(readings(spark, sf))


#: Queries that also run on the measured readings, which have nulls in most sensors.
MEASURED = ("rolling_stats", "lags", "diffs", "stuck_sensors", "sensor_profile", "missing_flags", "limit_breaches")


def _measured_query(f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: f(measured_readings(spark, sf))


def _alerts_query(f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: f(alert_table(spark, sf))


def _rules_query(f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: f(rule_frame(spark, sf))


def _hit_text(df: DataFrame) -> DataFrame:
    text = F.concat_ws("|", F.transform("rule_hits", lambda h: F.concat(h.cause, F.lit(":"), h.confidence.cast("string"))))
    return df.select(*IDS, text.alias("hits"))


def _features(r: DataFrame) -> DataFrame:
    f = X.build_features(r)
    return shown(f.select("site", "seq", "event_type", "potability", *X.feature_columns(f)))


def sql_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries that have a DuckDB counterpart."""
    on_readings = {
        "scan_readings": lambda r: rounded(r.filter(F.col("site").isin("S1", "S3"))),
        "time_encodings": lambda r: rounded(add_time_encodings(r).select(*IDS, "hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_night")),
        "sensor_ratios": lambda r: rounded(X.add_ratios(r).select(*IDS, *[x[0] for x in X.RATIOS])),
        "deviation_scores": lambda r: rounded(r.select(*IDS, *[deviation_score(s).alias(s) for s in LIMITS])),
        "risk_raw": lambda r: rounded(r.select(*IDS, risk_raw(r.columns).alias("risk_raw"))),
        "risk_series": lambda r: rounded(R.risk_series(r).select(*IDS, "ts", "event_type", "risk_raw", "risk")),
        "risk_levels": lambda r: R.risk_series(r).select(*IDS, risk_level("risk").alias("risk_level")),
        "risk_breakdown": lambda r: rounded(V.risk_breakdown(r), ["value", "deviation_score", "contribution"]),
        "score_readings": lambda r: rounded(V.score_readings(r).select(
            *IDS, "risk_index", "risk_level", "potability_probability", "potable", "primary_cause", "cause_confidence")),
        "clip_readings": lambda r: rounded(Q.clip_readings(r).select(*IDS, *LIMITS)),
        "diurnal_adjust": lambda r: rounded(Q.diurnal_adjust(r).select(*IDS, "chloramine_adj", "turbidity_adj", "conductivity_adj", "ph_adj")),
        "cause_labels": V.cause_labels,
        "last_n_readings": lambda r: R.last_n(r, 288).select("site", "seq", "event_id", "ts"),
        "limit_breaches": lambda r: rounded(Q.limit_breaches(r), ["value"]),
        "event_counts": V.event_counts,
        "rolling_stats": lambda r: shown(X.add_rolling(r).drop("event_id", "ts", "event_type", "potability", *SENSORS)),
        "ewma": lambda r: rounded(X.add_ewma(r).select(*IDS, *[f"{s}_ewma_{k}" for s in SENSORS for k in SPANS])),
        "diffs": lambda r: rounded(X.add_diffs(r).select(*IDS, *[f"{s}_diff{k}" for s in SENSORS for k in DIFFS])),
        "lags": lambda r: rounded(X.add_lags(r).select(*IDS, *[f"{s}_lag{k}" for s in SENSORS for k in LAGS])),
        "stuck_sensors": lambda r: X.add_stuck_flags(r).select(*IDS, *[f"{s}_stuck" for s in SENSORS]),
        "build_features": _features,
        "forecast_target": lambda r: rounded(P.forecast_targets(r.select(*IDS, *SENSORS), SENSORS)),
        "blocked_split": lambda r: P.blocked_split(r.select(*IDS)),
        "ordered_split": lambda r: P.ordered_split(r.select(*IDS)),
        "ordered_split_global": lambda r: P.ordered_split(r.select(*IDS), per_site=False),
        "sensor_profile": lambda r: rounded(Q.sensor_profile(r)),
        "rule_hits_raw": lambda r: _hit_text(D.rule_hits(r, raw_only=True)),
        "message_json": V.messages,
        "feed_labels": V.feed_labels,
        "first_n_readings": lambda r: V.first_n(r, 25).select("site", "seq", "event_id", "ts"),
        "latest_contributions": lambda r: rounded(V.latest_contributions(r).select("site", "seq", "rank", "sensor", "contribution")),
        "sensor_trends": lambda r: rounded(V.sensor_trends(r), ["value"]),
        "class_balance": lambda r: rounded(V.class_balance(r)),
        "union_of_sites": lambda r: rounded(IO.union_sites([r.filter(F.col("site") == f"S{i}").drop("turbidity" if i == 4 else "none")
                                                            for i in range(5)]).select(*IDS, "ph", "turbidity")),
        "parsed_times": lambda r: IO.with_parsed_time(r.select(*IDS, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"))),
        "risk_rank_metrics": lambda r: rounded(V.rank_metrics(
            written(r.select("potability", F.round(1 - risk_raw(r.columns) / 100, 6).alias("score")), "safe"), "potability", "score"), digits=9),
        "lags_of_slice": lambda r: rounded(X.add_lags(r.filter("seq >= 100")).select(*IDS, *[f"{s}_lag{k}" for s in SENSORS for k in LAGS])),
        "alert_log_of_slice": lambda r: rounded(V.alert_log(A.alert_states(r.filter("seq >= 100"), keep=["ts", "event_type"]))),
        "site_comparison": lambda r: rounded(V.site_comparison(r)),
        "site_comparison_24h": lambda r: rounded(V.site_comparison(r, 288)),
        "latest_diagnosis": lambda r: rounded(V.latest_diagnosis(r)),
        "data_table": lambda r: rounded(V.data_table(r)),
        "scenario_overlay": lambda r: rounded(N.overlay_scenarios(r, scenario_table(r)).select(
            *IDS, "event_type", "potability", "ph", "hardness", "chloramine", "thm", "turbidity", "conductivity", "organic_carbon")),
        "forecast_residuals": lambda r: rounded(Q.forecast_residuals(r).drop("ts")),
        "clip_bounds": lambda r: rounded(Q.clip_bounds(r).select(*IDS, "ph", "turbidity")),
        "ewma_impute": lambda r: rounded(Q.ewma_impute(r).select(*IDS, *SENSORS)),
        "missing_flags": lambda r: rounded(Q.missing_flags(r)),
        "drift_flags": lambda r: Q.drift_flags(r).drop("ts"),
        "amplified_risk": lambda r: rounded(Q.amplified_risk(r).drop("ts")),
    }
    on_alerts = {
        "alert_states": lambda a: rounded(a.select(*IDS, "risk", "alert_level", "alert_changed")),
        "alert_log": lambda a: rounded(V.alert_log(a)),
        "alert_summary": V.alert_summary,
        "alert_stats": V.alert_stats,
        "lead_times": V.lead_times,
        "lead_time_quantiles": lambda a: V.lead_time_quantiles(V.lead_time_sketches(a)),
        "lead_time_histogram": lambda a: V.lead_time_histogram(a, width_s=7200, bins=24),
        "false_alarms_per_day": lambda a: rounded(rounded(V.false_alarms_per_day(a), ["days", "per_day"]), ["mean_detect_s"], 3),
        "risk_stability": lambda a: rounded(V.risk_stability(a)),
        "alert_episodes": V.alert_episodes,
        "episode_durations": lambda a: rounded(rounded(V.episode_durations(a), ["avg_readings"]), ["avg_seconds"], 3),
        "threshold_compare": lambda a: rounded(V.threshold_compare(a)),
    }
    on_rules = {
        "rule_hits": lambda f: _hit_text(D.rule_hits(f)),
        "hybrid_diagnosis": lambda f: D.diagnose(f).select(*IDS, "diagnosis.primary_cause", "diagnosis.confidence"),
        "cause_ranking": lambda f: V.cause_ranking(D.diagnose(f)),
        "pseudo_labels": lambda f: V.pseudo_labels(f).select(*IDS, "event_type", "pseudo_label"),
        "confusion": lambda f: V.confusion(V.pseudo_labels(f)),
        "classification_report": lambda f: rounded(V.classification_report(V.pseudo_labels(f))),
    }
    on_measured = {f"measured_{k}": on_readings[k] for k in MEASURED}
    on_measured["measured_alert_states"] = lambda r: rounded(A.alert_states(r, keep=["ts", "event_type"]).select(*IDS, "risk", "alert_level", "alert_changed"))
    on_measured["measured_risk_series"] = lambda r: single(R.risk_series(r).select(*IDS, "risk_raw", "risk"))
    on_measured["measured_ewma"] = lambda r: single(X.add_ewma(r).select(*IDS, *[f"{s}_ewma_{k}" for s in SENSORS for k in SPANS]))
    on_measured["measured_ewma_impute"] = lambda r: single(Q.ewma_impute(r).select(*IDS, *SENSORS))
    return {**{k: _readings_query(f) for k, f in on_readings.items()},
            **{k: _measured_query(f) for k, f in on_measured.items()},
            **{k: _alerts_query(f) for k, f in on_alerts.items()},
            **{k: _rules_query(f) for k, f in on_rules.items()}}


# ---------------------------------------------------------------- files

def raw_csv_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The raw-sample path: a headed CSV under the original column names, read back and profiled."""
    path = new_path(spark, "raw-csv")
    original = {v: k for k, v in RAW_TO_SENSOR.items()}
    readings(spark, sf).select(*[F.col(c).alias(original[c]) for c in SENSORS],
                               F.col("potability").alias("Potability")).write.option("header", True).csv(path)
    return rounded(Q.sensor_profile(IO.read_raw_csv(spark, path)))


def partitioned_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Store all readings by site, then read two sites back (partition pruning)."""
    path = new_path(spark, "by-site")
    IO.write_readings(readings(spark, sf).select("site", "ts", *SENSORS, "potability", "event_type"), path)
    return rounded(IO.read_readings(spark, path, ["S1", "S3"]).select("site", "ts", "event_type", "potability", *SENSORS))


def csv_export(spark: SparkSession, sf: str) -> DataFrame:
    """Export the reading view with risk and alert level, and read the file back."""
    path = new_path(spark, "export")
    view = V.data_table(readings(spark, sf))
    IO.write_csv(view, path)
    return rounded(spark.read.schema(view.schema).options(header=True, **IO.CSV_TIME).csv(path))


# ---------------------------------------------------------------- models

def placed(spark: SparkSession, sf: str) -> DataFrame:
    return remembered(spark, _stamped(spark, sf, "placed"), lambda: M.placed(readings(spark, sf)))


def frame_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of the feature frame without the features: what needs none of them reads this."""
    return M.in_frame(placed(spark, sf))


def split_frame(spark: SparkSession, sf: str) -> DataFrame:
    return remembered(spark, _stamped(spark, sf, "split-frame"), lambda: M.placed_features(placed(spark, sf)))


def _family(spark, sf, name: str):
    """One family of models; a query fits only what it uses."""
    return remembered(spark, _stamped(spark, sf, f"{name}-model"), lambda: M.train_families(split_frame(spark, sf), families=(name,))[name])


def _potability(spark, sf):
    return _family(spark, sf, "potability")


def _cause(spark, sf):
    return _family(spark, sf, "cause")


def _forecasts(spark, sf):
    return _family(spark, sf, "forecast")


def _held_out(spark, sf):
    return split_frame(spark, sf).filter("role = 'validate'")


def blocked_split_features(spark, sf):
    """Folds of the feature frame, which has lost the rows with nulls."""
    return P.blocked_split(frame_rows(spark, sf).select(*IDS, "pos"), position="pos").drop("pos")


def ordered_split_features(spark, sf):
    return frame_rows(spark, sf).select(*IDS, "role")


def forecast_targets_features(spark, sf):
    return rounded(frame_rows(spark, sf).select(*IDS, *[f"target_{s}" for s in SENSORS]))


def naive_forecast_mae(spark, sf):
    return rounded(M.naive_mae(frame_rows(spark, sf)))


def potability_model(spark, sf):
    return M.potability_metrics(_potability(spark, sf), _held_out(spark, sf))


def cause_model_report(spark, sf):
    return V.classification_report(M.with_predicted_cause(_cause(spark, sf), _held_out(spark, sf)), "event_type", "predicted_cause")


def cause_confusion(spark, sf):
    return V.confusion(M.with_predicted_cause(_cause(spark, sf), _held_out(spark, sf)), "event_type", "predicted_cause")


def cause_confusion_totals(spark, sf):
    """Rows per true class of the confusion over the whole frame."""
    cells = V.confusion(M.with_predicted_cause(_cause(spark, sf), split_frame(spark, sf)), "event_type", "predicted_cause")
    return cells.select("event_type", sum((F.col(c) for c in cells.columns[1:]), F.lit(0).cast("bigint")).alias("n"))


def ml_hits(spark, sf):
    d = D.diagnose(split_frame(spark, sf), _cause(spark, sf))
    return d.select(*IDS, F.inline("diagnosis.ml_predictions"))


def hybrid_diagnosis_ml(spark, sf):
    d = D.diagnose(split_frame(spark, sf), _cause(spark, sf))
    return d.select(*IDS, "event_type", "diagnosis.primary_cause", "diagnosis.confidence")


def cause_attribution(spark, sf):
    """Rows in which the classifier sees a cause other than normal operation."""
    model = _cause(spark, sf)
    rows = M.with_predicted_cause(model, split_frame(spark, sf)).filter("predicted_cause <> 'normal'")
    return M.cause_attribution(rows.drop("probability", "prediction", "predicted_cause"), model)


def feature_importance(spark, sf):
    return M.importances(_potability(spark, sf), spark)


def importance_summary(spark, sf):
    """How many features have an importance, what they add up to, and whether ranks fall."""
    return feature_importance(spark, sf).agg(F.count("*").alias("n_features"), F.round(F.sum("importance"), 6).alias("total"),
                                             F.count_distinct("feature").alias("n_names"))


def importance_splits(spark, sf):
    """Splits on every feature of the label classifier, and their summed gain."""
    model = _potability(spark, sf)
    return rounded(M.split_counts(M.node_table(model), model.features))


def training_run(spark, sf):
    """All models saved, the importance file read back, and each model loaded again: name, features, trees, and
    the features that the file ranks."""
    models, path = {name: _family(spark, sf, name) for name in M.FAMILIES}, new_path(spark, "training-run")
    M.save_families(models, path)
    ranked = M.read_importance(spark, path).filter("importance > 0").count()
    places = {"potability": "potability", "cause": "cause", **{f"forecast_{s}": f"forecast/{s}" for s in models["forecast"]}}
    again = {name: M.load_model(spark, f"{path}/{at}") for name, at in places.items()}
    rows = [(name, len(m.features), m.model.getNumTrees if isinstance(m.model.getNumTrees, int) else m.model.getNumTrees(), ranked) for name, m in again.items()]
    return spark.createDataFrame(rows, "model string, n_features int, n_trees int, ranked_features long")


def top_importances(spark, sf):
    return feature_importance(spark, sf).limit(15)


def forecast_mae(spark, sf):
    return M.forecast_mae(_forecasts(spark, sf), split_frame(spark, sf))


def forecast_residuals_ml(spark, sf):
    return M.forecast_residual_scores(_forecasts(spark, sf), split_frame(spark, sf))


def future_risk(spark, sf):
    return M.future_risk(_forecasts(spark, sf), split_frame(spark, sf))


def cross_validation(spark, sf):
    return M.cross_validate(split_frame(spark, sf))


def model_save_load(spark, sf):
    """Predictions of the cause model before and after a round trip through storage, for every row."""
    path = new_path(spark, "cause-model")
    model, rows = _cause(spark, sf), split_frame(spark, sf)
    M.save_model(model, path)
    again = M.with_predicted_cause(M.load_model(spark, path), rows).select(*IDS, F.col("predicted_cause").alias("again"))
    return M.with_predicted_cause(model, rows).join(again, [*IDS]).select(*IDS, (F.col("again") == F.col("predicted_cause")).alias("same"))


# ---------------------------------------------------------------- spark.sql only

def _sql(text: str, alerts: bool = False, rules: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """A query that is nothing but SQL over the registered views and functions."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        SQL.register(spark, readings(spark, sf), alert_table(spark, sf) if alerts else None, rule_frame(spark, sf) if rules else None)
        return spark.sql(text)

    return run


def surface_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    r6 = lambda *names: ", ".join(f"round({c}, 6) AS {c}" for c in names)
    return {
        "sql_site_comparison": _sql(f"SELECT site, {r6('current_risk', 'avg_risk', 'max_risk')}, n_readings, status FROM site_comparison(50)"),
        "sql_site_comparison_24h": _sql(f"SELECT site, {r6('current_risk', 'avg_risk', 'max_risk')}, n_readings, status FROM site_comparison(n => 288)"),
        "sql_risk_levels": _sql("SELECT site, seq, risk_level(risk) AS risk_level FROM risk"),
        "sql_risk_raw": _sql(f"SELECT site, seq, round(risk_index({', '.join(SENSORS)}), 6) AS risk_raw FROM readings"),
        "sql_alerts_of_site": _sql("SELECT site, seq, round(risk, 6) AS risk, alert_level, alert_changed FROM alerts_of('S1')", alerts=True),
        "sql_breaches": _sql("SELECT site, seq, sensor, round(value, 6) AS value FROM breaches_of('turbidity')"),
        "sql_diagnoses": _sql("SELECT site, seq, primary_cause, confidence, cause_text(primary_cause) AS cause_text, cause_index(primary_cause) AS cause_index FROM diagnoses", rules=True),
    }


# ---------------------------------------------------------------- streams

#: Least number of time slices of a replayed table, and rows from which there are more.
SLICES, SLICE_ROWS = 3, 2_000_000


def _files(spark: SparkSession) -> int:
    """Files of a slice: as many as tasks after a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _replay(spark: SparkSession, sf: str) -> DataFrame:
    r = readings(spark, sf)

    def lay_out():
        path, files = new_path(spark, "replay"), _files(spark)
        SS.write_in_time_order(r, path, max(SLICES, -(-r.count() // SLICE_ROWS)), files)
        return path, files

    path, files = remembered(spark, _stamped(spark, sf, "replay"), lay_out)
    return SS.replay(spark, path, r.schema, files)


def _drained(spark: SparkSession, name: str, stream: DataFrame) -> DataFrame:
    return ST.run_to_table(stream, new_path(spark, name), new_path(spark, f"{name}-progress"))


def stream_scores(spark, sf):
    out = _drained(spark, "scores", SS.score_stream(_replay(spark, sf)))
    return rounded(out.select("site", "seq", "risk_index", "risk_level", "cause"))


def stream_alerts(spark, sf):
    """Alert levels of all readings, batch by batch."""
    out = ST.alert_stream(_replay(spark, sf), new_path(spark, "alert-stream"), order=("ts", "event_id"))
    return rounded(out.select("site", "ts", "risk", "alert_level", "alert_changed"))


def stream_features(spark, sf):
    """All features, batch by batch; rows with a null feature are dropped as in the batch frame."""
    f = ST.feature_stream(_replay(spark, sf), new_path(spark, "feature-stream"), order=("ts", "event_id"))
    cols = X.feature_columns(f)
    return shown(f.dropna(subset=[*cols, "potability"]).select("site", "seq", "event_type", "potability", *cols))


#: Slices of the arrivals below, and after them.
ARRIVALS, AFTER = 8, 2


def arrivals(events: DataFrame, n: int) -> DataFrame:
    """Events with the slice in which they arrive: every 13th a fifth of all events late, every 7th a
    little late, and every 17th once more some time after."""
    late = F.when(F.col("event_id") % 13 == 4, n / 5.0).when(F.col("event_id") % 7 == 2, n / 400.0).otherwise(0.0)
    copies = F.when(F.col("event_id") % 17 == 3, F.array(F.lit(0.0), F.lit(n / 30.0))).otherwise(F.array(F.lit(0.0)))
    at = events.withColumn("_again", F.explode(copies)).withColumn("_at", F.col("event_id") + late + F.col("_again"))
    turn = F.least(F.floor(F.col("_at") * ARRIVALS / n), F.lit(ARRIVALS + AFTER - 1)).cast("int")
    return at.withColumn("arrival", turn).drop("_again", "_at")


def stream_late_rows(spark, sf):
    """Alert levels of measured readings that arrive out of order, late and twice: what is behind the
    watermark when it arrives is dropped, and of doubled readings one counts."""
    events = measured_events(spark, sf)
    files = max(1, _files(spark) // 2)

    def lay_out():
        path, n = new_path(spark, "arrivals"), events.count()
        rows = arrivals(events, n)
        for turn in range(ARRIVALS + AFTER):  # each slice is one trigger: exactly ``files`` files
            SS.write_slices(rows.filter(F.col("arrival") == turn).drop("arrival"), [F.lit(True)], path, files)
        return path

    path = remembered(spark, _stamped(spark, sf, "arrivals"), lay_out)
    stream = as_measured(SS.replay(spark, path, events.schema, files))
    out = ST.alert_stream(stream, new_path(spark, "late-stream"), dedupe=True, order=("ts", "event_id"))
    return rounded(out.select(*IDS, "risk", "alert_level", "alert_changed"))


def job_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries that go through files, fitted models or streams."""
    return {f.__name__: f for f in (
        raw_csv_profile, partitioned_sink, csv_export, blocked_split_features, ordered_split_features, forecast_targets_features,
        naive_forecast_mae, potability_model, cause_model_report, cause_confusion, cause_confusion_totals, ml_hits, hybrid_diagnosis_ml,
        cause_attribution, feature_importance, importance_summary, importance_splits, training_run, top_importances, forecast_mae, forecast_residuals_ml, future_risk,
        cross_validation, model_save_load, stream_scores, stream_alerts, stream_features, stream_late_rows)}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**sql_queries(), **surface_queries(), **job_queries()}
