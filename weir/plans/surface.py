"""Everything within reach of ``spark.sql``: temp views and SQL functions over one set of readings.

:func:`register` names the readings, their smoothed risk, alert levels, level changes and
diagnoses as views, and defines scalar functions (``risk_index``, ``risk_level``,
``deviation_score``, ``potable_probability``, ``cause_text``, ``cause_index``) and table functions
(``last_readings(n)``, ``site_comparison(n)``, ``alerts_of(site)``, ``breaches_of(sensor)``). The functions
are SQL, so Spark inlines them into the query that calls them: filters and column pruning
reach through them, and nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import CAUSE_TEXT, CAUSES, LIMITS, RISK_BANDS, RISK_SPAN, SENSORS
from ..operators.diagnosis import diagnose
from ..operators.ewma import decay, reach
from ..operators.features import present
from ..operators.risk import risk_series
from . import views as V


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _score(sensor: str, v: str) -> str:
    m = LIMITS[sensor]
    return (f"CASE WHEN {v} IS NULL THEN 0D WHEN {v} < {m.low}D THEN least(30D + 70D * (({m.low}D - {v}) / {m.half}D), 100D) "
            f"WHEN {v} > {m.high}D THEN least(30D + 70D * (({v} - {m.high}D) / {m.half}D), 100D) ELSE least(30D * (abs({v} - {m.mid}D) / {m.half}D), 30D) END")


def scalar_functions() -> dict[str, str]:
    """Name to signature and body."""
    band = " ".join(f"WHEN x >= {bound}D THEN '{name}'" for bound, name in RISK_BANDS)
    of_sensor = " ".join(f"WHEN '{s}' THEN {_score(s, 'v')}" for s in LIMITS)
    total = " + ".join(f"CASE WHEN {s} IS NOT NULL THEN {m.weight}D * ({_score(s, s)}) ELSE 0D END" for s, m in LIMITS.items())
    weight = " + ".join(f"CASE WHEN {s} IS NOT NULL THEN {m.weight}D ELSE 0D END" for s, m in LIMITS.items())
    texts = " ".join(f"WHEN {_text(c)} THEN {_text(t)}" for c, t in CAUSE_TEXT.items())
    numbers = " ".join(f"WHEN {_text(c)} THEN {i}" for i, c in enumerate(CAUSES))
    return {
        "risk_level": f"(x DOUBLE) RETURNS STRING RETURN CASE {band} ELSE 'excellent' END",
        "deviation_score": f"(sensor STRING, v DOUBLE) RETURNS DOUBLE RETURN CASE sensor {of_sensor} ELSE 0D END",
        "risk_index": f"({', '.join(f'{s} DOUBLE' for s in SENSORS)}) RETURNS DOUBLE RETURN coalesce(try_divide({total}, {weight}), 0D)",
        "potable_probability": "(risk DOUBLE) RETURNS DOUBLE RETURN greatest(0D, 1D - risk / 100D)",
        "cause_text": f"(cause STRING) RETURNS STRING RETURN CASE cause {texts} ELSE cause END",
        "cause_index": f"(cause STRING) RETURNS INT RETURN CASE cause {numbers} ELSE 0 END",
    }


def table_functions(columns: list[str]) -> dict[str, str]:
    """Name to signature and body; the bodies read the views."""
    sensors = [s for s in SENSORS if s in columns]
    given = ", ".join(s if s in sensors else "CAST(NULL AS DOUBLE)" for s in SENSORS)
    q, far = decay(RISK_SPAN), reach(RISK_SPAN)
    slice_ = ("SELECT r.*, r.seq - greatest(z.n_rows - n, 0) AS pos FROM readings r JOIN (SELECT site AS z_site, max(seq) + 1 AS n_rows FROM readings GROUP BY site) z "
              "ON r.site = z.z_site WHERE r.seq >= z.n_rows - n")
    # smoothing starts with the slice; older terms than ``far`` do not show in a double
    fold = (f"aggregate(x, named_struct('n', 0D, 'd', 0D), (a, v) -> named_struct('n', a.n * {q!r}D + v, 'd', a.d * {q!r}D + 1D), a -> least(greatest(a.n / a.d, 0D), 100D))")
    smoothed = (f"SELECT site, seq, {fold} AS risk FROM (SELECT site, seq, collect_list(risk_index({given})) OVER (PARTITION BY site ORDER BY pos ROWS BETWEEN {far} PRECEDING AND CURRENT ROW) AS x "
                f"FROM ({slice_}))")
    limits = ", ".join(f"({_text(s)}, {m.low}D, {m.high}D)" for s, m in LIMITS.items())
    stack = ", ".join(f"{_text(s)}, {s}" for s in sensors)
    return {
        "last_readings": f"(n INT) RETURNS TABLE(site STRING, seq BIGINT, ts TIMESTAMP, {', '.join(f'{s} DOUBLE' for s in sensors)}) "
                         f"RETURN SELECT site, seq, ts, {', '.join(sensors)} FROM ({slice_})",
        "site_comparison": "(n INT DEFAULT 50) RETURNS TABLE(site STRING, current_risk DOUBLE, avg_risk DOUBLE, max_risk DOUBLE, n_readings BIGINT, status STRING) "
                           f"RETURN SELECT site, max_by(risk, seq), avg(risk), max(risk), count(*), upper(risk_level(max_by(risk, seq))) FROM ({smoothed}) GROUP BY site",
        "alerts_of": "(which STRING) RETURNS TABLE(site STRING, seq BIGINT, ts TIMESTAMP, risk DOUBLE, alert_level STRING, alert_changed BOOLEAN) "
                     "RETURN SELECT site, seq, ts, risk, alert_level, alert_changed FROM alerts WHERE site = which",
        "breaches_of": "(which STRING) RETURNS TABLE(site STRING, seq BIGINT, sensor STRING, value DOUBLE, low DOUBLE, high DOUBLE) "
                       f"RETURN SELECT site, seq, l.sensor, value, low, high FROM (SELECT site, seq, stack({len(sensors)}, {stack}) AS (name, value) FROM readings) v "
                       f"JOIN VALUES {limits} AS l(sensor, low, high) ON v.name = l.sensor WHERE l.sensor = which AND (value < low OR value > high)",
    }


def define(spark: SparkSession, functions: dict[str, str]) -> None:
    for name, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


def register(spark: SparkSession, readings: DataFrame, alerts: DataFrame | None = None, rule_frame: DataFrame | None = None) -> list[str]:
    """Define all views and functions over ``readings`` (numbered) and return their names. ``alerts`` and
    ``rule_frame`` may be given where they have been written already; without them the views that
    rest on them are left out (they cost a pass over the readings)."""
    views = {"readings": readings, "risk": risk_series(readings)}
    if alerts is not None:
        views |= {"alerts": alerts, "alert_log": V.alert_log(alerts), "alert_stats": V.alert_stats(alerts)}
    if rule_frame is not None:
        told = diagnose(rule_frame)
        views["diagnoses"] = told.select("site", "seq", "diagnosis.*")
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    functions = scalar_functions() | {k: v for k, v in table_functions(present(readings) + readings.columns).items() if k != "alerts_of" or alerts is not None}
    define(spark, functions)
    return [*views, *functions]
