"""Labelled what-if episodes laid over existing readings, for back-testing alerts.

``scenarios`` is a table (site, start_seq, duration, type). Each scenario is split over
the chunks it touches, so that the range condition becomes an equi-join on
(site, chunk) plus a filter: no site is joined as a whole and nothing is broadcast by
force. Where scenarios overlap, they apply in order of their start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import LAYOUT, Layout
from .chunks import CHUNK, div

# ---- fixed values: default length of each scenario in readings ----
DURATIONS = {
    "disinfectant_decay": 60,
    "contamination_intrusion": 40,
    "pipe_corrosion": 80,
    "stagnation": 100,
    "sensor_fault": 50,
}
TYPES = tuple(DURATIONS)

# fixed values: sensor -> (type -> change at full ramp); "scale" multiplies, "shift" adds
SCALE = {
    "chloramine": {"disinfectant_decay": -0.7, "stagnation": -0.5},
    "thm": {"disinfectant_decay": 0.8},
}
SHIFT = {
    "turbidity": {"contamination_intrusion": 3.0, "stagnation": 0.8},
    "conductivity": {"contamination_intrusion": 200.0, "pipe_corrosion": 100.0},
    "organic_carbon": {"contamination_intrusion": 5.0},
    "ph": {"pipe_corrosion": -1.5},
    "hardness": {"pipe_corrosion": 40.0},
}
STILL_POTABLE = ("sensor_fault",)


def _line(i: Column, n: Column, first: float, last: float) -> Column:
    """Value i of n equally spaced values from ``first`` to ``last``; ``first`` if n = 1."""
    return F.when(n > 1, first + (last - first) * i / (n - 1)).otherwise(F.lit(float(first)))


def ramp(kind: Column, i: Column, n: Column) -> Column:
    up = ((n - n % 2) / 2).cast("bigint")
    surge = F.when(i < up, _line(i, up, 0, 1)).otherwise(_line(i - up, n - up, 1, 0.6))
    return F.when(kind == "contamination_intrusion", surge).when(kind == "sensor_fault", 0.0).otherwise(_line(i, n, 0, 1))


def _change(table: dict, default: float, kind: Column, r: Column) -> Column:
    out = F.lit(default)
    for name, amount in table.items():
        out = F.when(kind == name, default + amount * r).otherwise(out)
    return out


def _scaled(s: str):
    return lambda value, e: value * e[f"x_{s}"]


def _shifted(s: str):
    return lambda value, e: value + e[f"p_{s}"]


def overlay_scenarios(readings: DataFrame, scenarios: DataFrame, key: str = "site",
                      layout: Layout = LAYOUT) -> DataFrame:
    """Readings with the scenarios applied; ``event_type`` and ``potability`` follow the
    latest-starting scenario on a row. Scenarios are cut at the end of their series."""
    sizes = readings.groupBy(key).agg((F.max("seq") + 1).alias("_size"))
    sc = scenarios.select(key, F.col("start_seq").cast("bigint").alias("_s"),
                          F.col("duration").cast("bigint").alias("_d"), F.col("type").alias("_type"))
    sc = (sc.join(sizes, key)
          .withColumn("_len", F.least(F.col("_d"), F.col("_size") - F.col("_s"))).filter("_len > 0")
          .drop("_d", "_size"))
    if "ph" in readings.columns:  # a stuck sensor holds the value at its start
        at_start = readings.select(key, F.col("seq").alias("_s"), F.col("ph").alias("_held"))
        sc = sc.join(at_start, [key, "_s"])
    spread = sc.withColumn(CHUNK, F.explode(F.sequence(div("_s", layout.chunk), div(F.col("_s") + F.col("_len") - 1, layout.chunk))))
    rows = readings.withColumn(CHUNK, div("seq", layout.chunk))
    hit = rows.select(key, "seq", CHUNK).join(spread, [key, CHUNK]).filter(
        (F.col("seq") >= F.col("_s")) & (F.col("seq") < F.col("_s") + F.col("_len")))
    r = ramp(F.col("_type"), F.col("seq") - F.col("_s"), F.col("_len"))
    parts = {"_s": F.col("_s"), "_type": F.col("_type")}
    have = set(readings.columns)
    for s in SCALE:
        if s in have:
            parts[f"x_{s}"] = _change(SCALE[s], 1.0, F.col("_type"), r)
    for s in SHIFT:
        if s in have:
            parts[f"p_{s}"] = _change(SHIFT[s], 0.0, F.col("_type"), r)
    if "ph" in have:
        parts["held"] = F.when(F.col("_type") == "sensor_fault", F.col("_held"))
    effect = F.struct(*[c.alias(k) for k, c in parts.items()])
    # the scenarios on one row, by start: as many as overlap there
    hits = hit.groupBy(key, "seq").agg(F.array_sort(F.collect_list(effect)).alias("_fx"))
    out = readings.join(hits, [key, "seq"], "left")
    on = F.col("_fx").isNotNull()
    new = {}
    for s in SCALE:
        if s in have:
            new[s] = F.aggregate("_fx", F.col(s), _scaled(s))
    for s in SHIFT:
        if s in have and s != "ph":
            new[s] = F.aggregate("_fx", F.col(s), _shifted(s))
    if "ph" in have:
        new["ph"] = F.aggregate("_fx", F.col("ph"), lambda acc, e: F.coalesce(e["held"], acc + e["p_ph"]))
    last = F.element_at("_fx", -1)["_type"]
    if "event_type" in have:
        new["event_type"] = last
    if "potability" in have:
        unsafe = F.exists("_fx", lambda e: ~e["_type"].isin(*STILL_POTABLE))
        new["potability"] = F.when(unsafe, 0).otherwise(F.col("potability"))
    return out.withColumns({k: F.when(on, v).otherwise(F.col(k)) for k, v in new.items()}).select(*readings.columns)
