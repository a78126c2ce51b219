"""Probable cause: expert rules, classifier probabilities, and their fusion.

Rules are data: (cause, predicate, confidence, explanation). A predicate is a Column,
so a rule set runs in codegen; null comparisons count as "no hit" by three-valued
logic. Fusion scores the fixed classes inline, so a diagnosis needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass


from pyspark.sql import Column, DataFrame, functions as F

from ..config import CAUSES, LIMITS

HIT = "array<struct<cause:string,confidence:double,explanation:string,method:string>>"
ML_HIT = "array<struct<cause:string,confidence:double,method:string>>"

# ---- fixed values: what a rule sees for a column that does not exist ----
MISSING = {"chloramine": 99.0, "ph": 7.0}


@dataclass(frozen=True)
class Rule:
    cause: str
    confidence: float
    explanation: str
    when: Callable[[Callable[[str], Column]], Column]


_LOW = {s: lim.low for s, lim in LIMITS.items()}
_HIGH = {s: lim.high for s, lim in LIMITS.items()}

# ---- fixed values: causes, confidences, thresholds, explanations ----
RULES = (
    Rule("disinfectant_decay", 0.85, "Chloramine below safe threshold + THM rising → disinfection breakdown",
         lambda v: (v("chloramine") < _LOW["chloramine"] * 1.5) & (v("thm") > _HIGH["thm"] * 0.7)),
    Rule("contamination_intrusion", 0.80, "Turbidity spike + conductivity jump → possible pipe break / intrusion",
         lambda v: (v("turbidity") > _HIGH["turbidity"] * 0.8) & (v("conductivity") > _HIGH["conductivity"] * 0.6)),
    Rule("pipe_corrosion", 0.75, "Low pH + elevated hardness → pipe corrosion / metal leaching",
         lambda v: (v("ph") < _LOW["ph"]) & (v("hardness") > 220)),
    Rule("stagnation", 0.70,
         "Gradual chloramine decay + slight turbidity rise → stagnation in dead-end pipe",
         lambda v: (v("chloramine") < _LOW["chloramine"] * 2.0) & (v("turbidity_diff1") > 0)
         & (v("chloramine_diff1") < 0)),
    Rule("sensor_fault", 0.90, "Zero variance detected on sensor → stuck/faulty sensor reading",
         lambda v: (v("ph_stuck") == 1) | (v("conductivity_stuck") == 1) | (v("chloramine_stuck") == 1)),
    Rule("operational_change", 0.65,
         "Sudden chloramine shift without turbidity change → treatment dosing change",
         lambda v: (F.abs(v("chloramine_diff3")) > 1.5) & (v("turbidity") < _HIGH["turbidity"])),
)

NEEDS = {"diffs": ("turbidity", "chloramine"), "stuck": ("ph", "conductivity", "chloramine")}


def _value(columns, raw_only: bool) -> Callable[[str], Column]:
    def get(name: str) -> Column:
        derived = name.endswith(("_diff1", "_diff3", "_stuck"))
        if name in columns and not (raw_only and derived):
            return F.col(name)
        return F.lit(MISSING.get(name, 0.0))
    return get


def rule_hits_column(columns, rules: Sequence[Rule] = RULES, raw_only: bool = False) -> Column:
    """Hits by falling confidence. Rule order settles equal confidences."""
    get = _value(set(columns), raw_only)
    ranked = sorted(rules, key=lambda r: -r.confidence)
    hits = [F.when(r.when(get), F.struct(F.lit(r.cause).alias("cause"), F.lit(r.confidence).alias("confidence"),
                                         F.lit(r.explanation).alias("explanation"), F.lit("rule").alias("method")))
            for r in ranked]
    return F.filter(F.array(*hits), lambda h: h.isNotNull()).cast(HIT)


def rule_hits(df: DataFrame, rules: Sequence[Rule] = RULES, raw_only: bool = False) -> DataFrame:
    return df.withColumn("rule_hits", rule_hits_column(df.columns, rules, raw_only))


def ml_hits_column(probability: Column, classes: Sequence[str] = CAUSES, floor: float = 0.1) -> Column:
    """Class probabilities above ``floor``, rounded to 3 places, highest first.
    Class order settles equal probabilities."""
    named = F.array(*[
        F.struct((-F.round(F.get(probability, F.lit(i)), 3)).alias("k"), F.lit(i).alias("i"),
                 F.lit(c).alias("cause"), F.get(probability, F.lit(i)).alias("p"))
        for i, c in enumerate(classes)])
    kept = F.array_sort(F.filter(named, lambda h: h.p > floor))
    return F.transform(kept, lambda h: F.struct(h.cause.alias("cause"), (-h.k).alias("confidence"),
                                                F.lit("ml_classifier").alias("method"))).cast(ML_HIT)


def fused_scores(rule: Column, ml: Column, w_rule: float, w_ml: float, causes: Sequence[str]) -> Column:
    """Causes with their joint score, best first. Ties keep the order in which a cause first
    appears: rule hits by confidence, then classifier hits."""
    order = F.array_distinct(F.concat(F.transform(rule, lambda h: h.cause), F.transform(ml, lambda h: h.cause)))

    def score(hits, cause, weight):
        picked = F.filter(hits, lambda h: h.cause == cause)
        return F.aggregate(picked, F.lit(0.0), lambda acc, h: acc + h.confidence * weight)

    scored = F.array(*[
        F.struct((-(score(rule, c, w_rule) + score(ml, c, w_ml))).alias("k"),
                 F.array_position(order, F.lit(c)).alias("i"), F.lit(c).alias("cause")) for c in causes])
    return F.transform(F.array_sort(F.filter(scored, lambda h: h.i > 0)),
                       lambda h: F.struct(h.cause.alias("cause"), (-h.k).alias("score")))


def diagnose(df: DataFrame, cause_model=None, w_rule: float = 0.5, w_ml: float = 0.5, raw_only: bool = False,
             rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``diagnosis``. Without a model the classifier list is empty and the fusion is
    rule-only, so a lone rule counts half its confidence."""
    causes = list(dict.fromkeys([*CAUSES, *(r.cause for r in rules)]))
    if cause_model is not None:
        from pyspark.ml.functions import vector_to_array

        df = cause_model.transform(df).withColumn(
            "_ml", ml_hits_column(vector_to_array("probability"), cause_model.classes))
    else:
        df = df.withColumn("_ml", F.array().cast(ML_HIT))
    df = rule_hits(df, rules, raw_only)
    rule, ml = F.col("rule_hits"), F.col("_ml")
    if cause_model is None and len({r.cause for r in rules}) == len(rules):
        ranked = F.transform(rule, lambda h: F.struct(h.cause.alias("cause"), (h.confidence * w_rule).alias("score")))
    else:
        ranked = fused_scores(rule, ml, w_rule, w_ml, causes)
    # one step per column, so that each list is built once per row
    df = df.withColumn("_ranked", ranked)
    top = F.get("_ranked", F.lit(0))
    df = df.withColumns({"_cause": F.coalesce(top.getField("cause"), F.lit("normal")),
                         "_conf": F.round(F.least(F.coalesce(top.getField("score"), F.lit(1.0)), F.lit(1.0)), 3)})
    full = F.struct(
        F.col("_cause").alias("primary_cause"), F.col("_conf").alias("confidence"),
        F.transform("_ranked", lambda h: F.struct(h.cause.alias("cause"), F.round(h.score, 3).alias("score")))
        .alias("all_causes"),
        F.transform(F.filter(rule, lambda h: h.cause == F.col("_cause")), lambda h: h.explanation)
        .alias("rule_explanations"),
        rule.alias("rule_hits"), ml.alias("ml_predictions"))
    return df.withColumn("diagnosis", full).drop("_ml", "_ranked", "_cause", "_conf")


def rule_feature_frame(readings: DataFrame, layout=None) -> DataFrame:
    """Readings plus just the derived columns the rules look at (one exchange)."""
    from ..config import LAYOUT, STUCK_WINDOW
    from .features import Wanted, present, window_features

    layout = layout or LAYOUT
    sensors = present(readings, ("ph", "conductivity", "chloramine", "turbidity"))
    return window_features(readings, Wanted(sensors=sensors, diffs=(1, 3), stuck=STUCK_WINDOW), layout=layout)


