"""Readings derived from the ``events`` table (see FIXTURES.md, section 3).

The derivation is a narrow projection over numbered events: five sites from the
user id, deterministic jitter, and six labelled episodes in every 200 readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import once, stamp
from .numbering import number_series

_JITTER = "(((event_id * {k}) % 101) / 100.0e0 - 0.5e0)"

_EPISODE = """CASE
 WHEN seq % 200 BETWEEN 20 AND 44 THEN 'disinfectant_decay'
 WHEN seq % 200 BETWEEN 60 AND 84 THEN 'contamination_intrusion'
 WHEN seq % 200 BETWEEN 100 AND 119 THEN 'pipe_corrosion'
 WHEN seq % 200 BETWEEN 130 AND 149 THEN 'stagnation'
 WHEN seq % 200 BETWEEN 160 AND 184 THEN 'sensor_fault'
 WHEN seq % 200 BETWEEN 190 AND 199 THEN 'operational_change' ELSE 'normal' END"""

_RAMP = """CASE event_type
 WHEN 'disinfectant_decay' THEN (seq % 200 - 20) / 24.0e0
 WHEN 'contamination_intrusion' THEN CASE WHEN seq % 200 <= 72 THEN (seq % 200 - 60) / 12.0e0
   ELSE 1.0e0 - 0.6e0 * (seq % 200 - 72) / 12.0e0 END
 WHEN 'pipe_corrosion' THEN (seq % 200 - 100) / 19.0e0
 WHEN 'stagnation' THEN (seq % 200 - 130) / 19.0e0
 WHEN 'operational_change' THEN 1.0e0 ELSE 0.0e0 END"""


def _effect(**by_type: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in by_type.items())
    return f"(CASE event_type {arms} ELSE 0 END) * ramp"


def _sensor_exprs() -> dict[str, str]:
    j = {k: _JITTER.format(k=k) for k in (7, 11, 13, 17, 19, 23, 29, 31, 37)}
    return {
        "ph": f"CASE WHEN event_type = 'sensor_fault' THEN 7.4e0 ELSE 7.4e0 + 0.6e0 * {j[7]} - "
              + _effect(pipe_corrosion="2.4e0", contamination_intrusion="3.0e0") + " END",
        "hardness": f"180 + 60 * {j[11]} + " + _effect(pipe_corrosion="80"),
        "tds": f"350 + 120 * {j[13]}",
        "chloramine": f"CASE WHEN event_id % 97 = 5 THEN NULL ELSE (2.4e0 + 0.8e0 * {j[17]}) * (1 - "
                      + _effect(disinfectant_decay="0.93e0", stagnation="0.9e0") + ") + "
                      + _effect(contamination_intrusion="5", operational_change="2.2e0") + " END",
        "sulfate": f"150 + 60 * {j[19]}",
        "conductivity": f"420 + 80 * {j[23]} + " + _effect(contamination_intrusion="1200", pipe_corrosion="100"),
        "organic_carbon": f"2.5e0 + 1.0e0 * {j[29]} + " + _effect(contamination_intrusion="9"),
        "thm": f"(50 + 16 * {j[31]}) * (1 + " + _effect(disinfectant_decay="1.2e0", contamination_intrusion="2.0e0") + ")",
        "turbidity": f"2.0e0 + 0.8e0 * {j[37]} + " + _effect(contamination_intrusion="6", stagnation="0.8e0"),
    }


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as (site, ts, event_id, seq), numbered once per application."""

    def build():
        ev = spark.read.parquet(f"{sf_dir}/events.parquet")
        return number_series(
            ev.select(F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("site"),
                      F.col("ts").cast("timestamp").alias("ts"), "event_id"),
            order=("ts", "event_id"),
        )

    return once(spark, ("events", sf_dir, stamp(spark, f"{sf_dir}/events.parquet")), build)


def as_readings(numbered: DataFrame) -> DataFrame:
    """Sensor columns as a projection of (event_id, seq); pruned to what a query uses."""
    return (
        numbered.withColumn("event_type", F.expr(_EPISODE))
        .withColumn("ramp", F.expr(_RAMP))
        .select(
            "event_id", "ts", "site", "seq", "event_type",
            *[F.expr(sql).cast("double").alias(name) for name, sql in _sensor_exprs().items()],
            F.expr("CASE WHEN event_type IN ('normal', 'sensor_fault', 'operational_change') THEN 1 ELSE 0 END")
            .alias("potability"),
        )
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_readings(numbered_events(spark, sf_dir))


# Each kind of event measures some of the sensors; its value is the measurement.
_MEASURED = {
    "ph": "CASE WHEN kind <> 'view' THEN 5.5e0 + 0.02e0 * value END",
    "hardness": "CASE WHEN kind IN ('signup', 'click', 'error') THEN 120 + value END",
    "tds": "300 + 2 * value",
    "chloramine": "CASE WHEN kind <> 'error' THEN 3 - 0.02e0 * value END",
    "sulfate": "CASE WHEN kind IN ('purchase', 'view') THEN 100 + value END",
    "conductivity": "350 + 4 * value",
    "organic_carbon": "1 + 0.05e0 * value",
    "thm": "CASE WHEN kind <> 'signup' THEN 30 + 0.9e0 * value END",
    "turbidity": "0.5e0 + 0.06e0 * value",
}


def measured_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as (site, ts, event_id, kind, value)."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select(F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("site"), F.col("ts").cast("timestamp").alias("ts"),
                     "event_id", F.col("event_type").alias("kind"), "value")


def as_measured(events: DataFrame) -> DataFrame:
    """Sensor columns of measured events (numbered or not)."""
    cause = F.expr("CASE kind WHEN 'error' THEN 'sensor_fault' WHEN 'purchase' THEN 'operational_change' WHEN 'view' THEN 'stagnation' ELSE 'normal' END")
    return events.select("event_id", "ts", "site", *[c for c in ("seq",) if c in events.columns], cause.alias("event_type"),
                         *[F.expr(e).cast("double").alias(s) for s, e in _MEASURED.items()],
                         F.expr("CASE WHEN value < 100 THEN 1 ELSE 0 END").alias("potability"))


def measured_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings whose sensors come from the measured column ``events.value``, with nulls in most sensors."""
    rows = once(spark, ("measured", sf_dir, stamp(spark, f"{sf_dir}/events.parquet")),
                lambda: number_series(measured_events(spark, sf_dir), order=("ts", "event_id")))
    return as_measured(rows)
