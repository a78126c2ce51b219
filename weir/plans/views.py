"""Operator views: what an operations screen, a scoring service or an export shows.

Functions take numbered readings (or the alert table of
:func:`weir.operators.alerts.alert_states`) and return DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import CAUSES, LAYOUT, LIMITS, SENSORS, AlertParams, Layout
from ..functions.scoring import deviation_score, potable_probability, risk_level, risk_raw, scored_sensors
from ..functions.text import cause_text, pretty, round_binary, value_with_unit
from ..operators.alerts import alert_states
from ..operators.chunks import CHUNK, carry, div, in_chunk
from ..operators.diagnosis import diagnose, rule_hits_column
from ..operators.risk import last_n, risk_series
from ..operators.sites import with_site_values
from ..sources.numbering import series_sizes

# ---------------------------------------------------------------- risk breakdown

def _parts(columns, digits: int | None = None):
    show = (lambda c: round_binary(c, digits)) if digits is not None else (lambda c: c)
    for s in scored_sensors(columns):
        lim, score = LIMITS[s], deviation_score(s)
        yield s, [F.col(s).alias("value"), show(score).alias("deviation_score"), F.lit(lim.weight).alias("weight"),
                  show(lim.weight * score).alias("contribution"), F.lit(lim.unit).alias("unit"),
                  F.lit(lim.label).alias("safe_range")]


def risk_breakdown(df: DataFrame, digits: int | None = None, ids=("site", "ts", "seq")) -> DataFrame:
    """One row per reading and present sensor: value, deviation_score, weight, contribution
    (weight times score), unit, safe range and the value as display text."""
    ids = [c for c in ids if c in df.columns]
    arr = F.array(*[
        F.when(F.col(s).isNotNull(), F.struct(F.lit(s).alias("sensor"), *cols,
                                              value_with_unit(s, LIMITS[s].unit).alias("value_text")))
        for s, cols in _parts(df.columns, digits)])
    return df.select(*ids, F.inline(F.filter(arr, lambda x: x.isNotNull())))


def breakdown_map(columns, digits: int | None = 1):
    """The same as one map column sensor -> struct."""
    entries = F.array(*[F.when(F.col(s).isNotNull(), F.struct(F.lit(s).alias("key"), F.struct(*cols).alias("value")))
                        for s, cols in _parts(columns, digits)])
    return F.map_from_entries(F.filter(entries, lambda x: x.isNotNull()))


# ---------------------------------------------------------------- scoring

def score_readings(df: DataFrame, digits: bool = False, raw_only: bool = True, cause_model=None) -> DataFrame:
    """Score every reading on its own: a narrow projection, in batch or on a stream.

    ``digits=True`` rounds for display as the service response does."""
    scored = diagnose(df.withColumn("risk_index", risk_raw(df.columns)), cause_model, raw_only=raw_only)
    prob = potable_probability("risk_index")
    show = (lambda c, d: round_binary(c, d)) if digits else (lambda c, d: c)
    ids = [c for c in ("site", "ts", "seq", "event_id") if c in df.columns]
    return scored.select(
        *ids, show(F.col("risk_index"), 1).alias("risk_index"), risk_level("risk_index").alias("risk_level"),
        show(prob, 3).alias("potability_probability"), (prob > 0.5).alias("potable"),
        F.col("diagnosis.primary_cause").alias("primary_cause"), F.col("diagnosis.confidence").alias("cause_confidence"),
        breakdown_map(df.columns, 1 if digits else None).alias("risk_breakdown"),
        F.col("diagnosis").alias("cause_details"))


def message_column(columns, digits: int = 3):
    """The message of the live feed as JSON. Null sensors are left out. Uses the unsmoothed
    risk and the first rule hit, as the feed does."""
    sensors = [s for s in SENSORS if s in columns]
    hits = rule_hits_column(columns, raw_only=True)
    cause = F.coalesce(F.get(hits, F.lit(0)),
                       F.struct(F.lit("normal").alias("cause"), F.lit(None).cast("double").alias("confidence"),
                                F.lit(None).cast("string").alias("explanation"), F.lit(None).cast("string").alias("method")))
    event = F.col("event_type") if "event_type" in columns else F.lit("normal")
    return F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.struct(*[round_binary(s, digits).alias(s) for s in sensors]).alias("sensors"),
        round_binary(risk_raw(columns), 1).alias("risk_index"), event.alias("event_type"), cause.alias("cause")))


def messages(df: DataFrame) -> DataFrame:
    return df.select("site", "seq", message_column(df.columns).alias("message"))


def feed_labels(df: DataFrame, sensors=None) -> DataFrame:
    """Short sensor captions and values of the live feed, one row per sensor present."""
    have = [s for s in (sensors or SENSORS) if s in df.columns]
    arr = F.array(*[F.when(F.col(s).isNotNull(), F.struct(pretty(F.lit(s), 10).alias("caption"),
                                                          F.format_string("%.1f", round_binary(s, 1)).alias("text"))) for s in have])
    return df.select("site", "seq", F.inline(F.filter(arr, lambda x: x.isNotNull())))


# ---------------------------------------------------------------- screens

def site_comparison(df: DataFrame, n: int = 50, layout: Layout = LAYOUT) -> DataFrame:
    """Current, mean and highest smoothed risk per site over its last ``n`` readings (smoothing
    starts with the slice)."""
    risk = risk_series(last_n(df, n), layout=layout)
    out = risk.groupBy("site").agg(F.max_by("risk", "seq").alias("current_risk"), F.avg("risk").alias("avg_risk"),
                                   F.max("risk").alias("max_risk"), F.count("*").alias("n_readings"))
    return out.withColumn("status", F.upper(risk_level("current_risk")))


def latest(df: DataFrame, key: str = "site") -> DataFrame:
    """Newest row per site. An aggregation: keeps one row per site and task."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), "seq").alias("_r")).select(key, "_r.*")


def latest_diagnosis(df: DataFrame, n: int = 288, raw_only: bool = True, layout: Layout = LAYOUT) -> DataFrame:
    """Alert banner: newest reading per site with its risk, alert level and diagnosis."""
    alerts = alert_states(last_n(df, n), layout=layout)
    now = diagnose(latest(alerts), raw_only=raw_only)
    shown = F.col("alert_level") != "normal"
    return now.select(
        "site", "ts", "risk", risk_level("risk").alias("risk_level"), "alert_level",
        F.when(shown, F.col("diagnosis.primary_cause")).alias("banner_cause"),
        F.when(shown, F.col("diagnosis.confidence")).alias("banner_confidence"),
        F.when(F.col("alert_level") == "critical", F.get("diagnosis.rule_explanations", F.lit(0))).alias("banner_evidence"),
        F.col("diagnosis.primary_cause").alias("primary_cause"),
        cause_text("diagnosis.primary_cause").alias("cause_text"))


def latest_contributions(df: DataFrame) -> DataFrame:
    """What each sensor adds to the risk of the newest reading of its site, largest first."""
    parts = risk_breakdown(latest(df))
    rank = F.row_number().over(W.partitionBy("site").orderBy(F.desc("contribution"), "sensor"))  # nine rows per site
    return parts.withColumn("rank", rank)


def sensor_trends(df: DataFrame, sensors=None) -> DataFrame:
    """Every sensor as a series of (value, low, high, outside), one row per reading and sensor."""
    have = [s for s in (sensors or LIMITS) if s in df.columns]
    rows = F.array(*[F.struct(F.lit(s).alias("sensor"), F.col(s).alias("value"), F.lit(LIMITS[s].low).alias("low"),
                              F.lit(LIMITS[s].high).alias("high"), F.lit(LIMITS[s].unit).alias("unit")) for s in have])
    return df.select("site", "ts", "seq", F.inline(rows)).withColumn("outside", ~F.col("value").between(F.col("low"), F.col("high")))


def class_balance(df: DataFrame, label: str = "potability") -> DataFrame:
    """Readings per class of the label and their share."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select(  # one row
        label, "n", (F.col("n") / F.col("total")).alias("share"))


def first_n(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` readings of each site."""
    starts = df.groupBy("site").agg(F.min("seq").alias("_start"))
    return with_site_values(df, starts).filter(F.col("seq") < F.col("_start") + n).drop("_start")


def cause_ranking(diagnosed: DataFrame) -> DataFrame:
    """Ranked causes of each diagnosed row, rank 1 first."""
    return diagnosed.select("site", "seq", F.posexplode("diagnosis.all_causes").alias("pos", "c")).select(
        "site", "seq", (F.col("pos") + 1).alias("rank"), F.col("c.cause").alias("cause"), F.col("c.score").alias("score"))


def event_counts(df: DataFrame, include_normal: bool = False) -> DataFrame:
    rows = df if include_normal else df.filter("event_type <> 'normal'")
    return rows.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


def data_table(df: DataFrame, n: int = 288, rows: int = 200, layout: Layout = LAYOUT) -> DataFrame:
    """The newest ``rows`` readings of each site's slice, newest first, with risk and alert level."""
    full = alert_states(last_n(df, n), layout=layout)
    cols = [c for c in ("ts", "site", *SENSORS, "risk", "alert_level", "event_type") if c in full.columns]
    sizes = series_sizes(full)
    return (with_site_values(full, sizes).filter(F.col("seq") >= F.col("n_rows") - rows)
            .select(*cols).orderBy("site", F.desc("ts")))


def alert_log(alerts: DataFrame) -> DataFrame:
    """Changes of alert level. The first reading of a series counts as a change."""
    return (alerts.filter(F.col("prev_ts").isNull() | F.col("alert_changed"))
            .select("site", "seq", "ts", "alert_level", "risk", "event_type"))


def alert_stats(alerts: DataFrame) -> DataFrame:
    """Counts over the alert log; a false alarm is an alert raised during normal operation."""
    up = F.col("alert_level") != "normal"
    return alert_log(alerts).groupBy("site").agg(
        F.count_if(up).alias("total_alerts"), F.count_if(F.col("alert_level") == "critical").alias("critical_alerts"),
        F.count_if(F.col("alert_level") == "warning").alias("warnings"),
        F.count_if(up & (F.col("event_type") == "normal")).alias("false_alarms"))


def alert_summary(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("site").agg(
        F.count_if(F.col("alert_level") == "warning").alias("n_warning"),
        F.count_if(F.col("alert_level") == "critical").alias("n_critical"), F.count("*").alias("n_readings"))


def cause_labels(df: DataFrame) -> DataFrame:
    from ..functions.text import cause_index

    return df.select("site", "seq", "event_type", pretty("event_type").alias("label"),
                     pretty("event_type", 10).alias("short_label"), cause_text("event_type").alias("description"),
                     cause_index("event_type").alias("class_index"))


# ---------------------------------------------------------------- alert evaluation

def alert_episodes(alerts: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """Runs of one alert level: start, end, readings and seconds from first to last reading.

    Works on the level changes only; the next change is looked up in the same chunk or
    carried back from a later one."""
    starts = alerts.filter(F.col("prev_ts").isNull() | F.col("alert_changed")).select(
        "site", "seq", F.col("ts").alias("start_ts"), "alert_level", "prev_ts", div("seq", layout.chunk).alias(CHUNK))
    w = in_chunk()
    ahead = F.lead(F.struct(F.col("seq").alias("s"), F.col("prev_ts").alias("t"))).over(w)
    first = starts.groupBy("site", CHUNK).agg(F.min("seq").alias("_s"), F.min_by("prev_ts", "seq").alias("_t"))
    later = carry(first, CHUNK, ["_s", "_t"], forward=False, fan=layout.fan)
    ends = alerts.groupBy("site").agg((F.max("seq") + 1).alias("n_rows"), F.max_by("ts", "seq").alias("last_ts"))
    out = starts.withColumn("_a", ahead).join(later, ["site", CHUNK], "left").join(ends, "site")
    stop = F.coalesce("_a.s", "_s", "n_rows")
    end = F.coalesce("_a.t", "_t", "last_ts")
    return out.select("site", "seq", "alert_level", "start_ts", end.alias("end_ts"),
                      (stop - F.col("seq")).alias("n_readings"),
                      (F.unix_micros(end) - F.unix_micros("start_ts")).alias("duration_us"))


def episode_durations(alerts: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    return alert_episodes(alerts, layout).groupBy("alert_level").agg(
        F.count("*").alias("n_episodes"), F.avg("n_readings").alias("avg_readings"),
        (F.avg("duration_us") / 1e6).alias("avg_seconds"))


def lead_times(alerts: DataFrame) -> DataFrame:
    """Per labelled event: seconds from its onset to the first alerting reading in it (null: missed)."""
    up = F.when(F.col("alert_level") != "normal", F.col("ts"))
    return (alerts.filter("event_type <> 'normal'").groupBy("site", "event_start", "event_type")
            .agg(F.min("ts").alias("onset"), F.min(up).alias("first_alert"), F.count("*").alias("n_readings"))
            .withColumn("lead_us", F.unix_micros("first_alert") - F.unix_micros("onset")))


def lead_time_histogram(alerts: DataFrame, width_s: int = 600, bins: int = 12) -> DataFrame:
    """Detected events per lead-time bucket; the last bucket takes the rest."""
    lead = lead_times(alerts).filter("lead_us IS NOT NULL")
    bucket = F.least(F.floor(F.col("lead_us") / (width_s * 1000000)), F.lit(bins)).cast("int")
    return lead.groupBy("event_type", bucket.alias("bucket")).agg(F.count("*").alias("n_events"))


def lead_time_sketches(alerts: DataFrame, size: int = 2048) -> DataFrame:
    """A mergeable quantile sketch of the lead times per site and event type: what days or regions store
    to be added up later by :func:`lead_time_quantiles`. Exact up to ``size`` detected events."""
    lead = lead_times(alerts).filter("lead_us IS NOT NULL")
    return lead.groupBy("site", "event_type").agg(F.count("*").alias("n_events"), F.kll_sketch_agg_bigint("lead_us", F.lit(size)).alias("sketch"))


def lead_time_quantiles(sketches: DataFrame, ranks=(0.5, 0.9, 0.99), by=("event_type",)) -> DataFrame:
    """Lead times (microseconds) at ``ranks`` from merged sketches: the smallest value that at least this share
    of the detected events does not exceed. The rank error is that of the sketch, about 1.3 / size."""
    merged = sketches.groupBy(*by).agg(F.sum("n_events").alias("n_events"), F.kll_merge_agg_bigint("sketch").alias("sketch")).filter("n_events > 0")
    return merged.select(*by, "n_events", *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(q))).alias(f"lead_us_p{round(q * 100)}") for q in ranks])


def false_alarms_per_day(alerts: DataFrame) -> DataFrame:
    """False alarms per day of data and mean time to detect, per site."""
    days = alerts.groupBy("site").agg(
        ((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 86400e6).alias("days"))
    detect = lead_times(alerts).groupBy("site").agg((F.avg("lead_us") / 1e6).alias("mean_detect_s"))
    return (alert_stats(alerts).select("site", "false_alarms").join(days, "site").join(detect, "site", "left")
            .select("site", "false_alarms", "days", F.try_divide("false_alarms", "days").alias("per_day"), "mean_detect_s"))


def risk_stability(risk: DataFrame) -> DataFrame:
    return risk.filter("event_type = 'normal'").groupBy("site").agg(
        F.var_samp("risk").alias("risk_variance"), F.count("*").alias("n_readings"))


def threshold_compare(alerts: DataFrame, warn: float = AlertParams().warn, layout: Layout = LAYOUT) -> DataFrame:
    """Upward crossings of a plain threshold on the unsmoothed risk against alerts raised."""
    from ..operators.splits import lagged

    prev = lagged(alerts.select("site", "seq", "risk_raw", "alert_level", "previous_level"),
                  {"_before": ("risk_raw", 1)}, layout)
    crossed = (F.col("risk_raw") >= warn) & (F.coalesce(F.col("_before"), F.lit(0.0)) < warn)
    raised = (F.col("previous_level") == "normal") & (F.col("alert_level") != "normal")
    return (prev.groupBy("site").agg(F.count_if(crossed).alias("naive_alerts"), F.count_if(raised).alias("raised_alerts"))
            .withColumn("reduction", 1 - F.try_divide("raised_alerts", "naive_alerts")))


# ---------------------------------------------------------------- labels and metrics

def pseudo_labels(df: DataFrame) -> DataFrame:
    """Top rule hit as a label for unlabelled readings; ``normal`` without a hit."""
    hits = rule_hits_column(df.columns)
    return df.withColumn("pseudo_label", F.coalesce(F.get(hits, F.lit(0)).getField("cause"), F.lit("normal")))


def confusion(df: DataFrame, label: str = "event_type", pred: str = "pseudo_label", classes=CAUSES) -> DataFrame:
    """Predicted classes as columns per true class. Counts cells first, then turns them."""
    cells = df.groupBy(label, pred).agg(F.count("*").alias("n"))
    return cells.groupBy(label).pivot(pred, list(classes)).agg(F.sum("n")).fillna(0)


def classification_report(df: DataFrame, label: str = "event_type", pred: str = "pseudo_label") -> DataFrame:
    """Precision, recall, F1 and support per class present in labels or predictions."""
    cells = df.groupBy(F.col(label).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("t").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 hit.cast("bigint").alias("hits")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits")))))
    s = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    zero = F.lit(0.0)
    return s.select("class", F.coalesce(F.try_divide("hits", "predicted"), zero).alias("precision"),
                    F.coalesce(F.try_divide("hits", "support"), zero).alias("recall"),
                    F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("predicted")), zero).alias("f1"),
                    "support")


def macro_f1(report: DataFrame) -> DataFrame:
    return report.agg(F.avg("f1").alias("macro_f1"))


def rank_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC and the precision-recall curve from (label 0/1, score).

    Counts per distinct score are accumulated from the highest score down, over range
    partitions: offsets come from per-partition totals, so no task sees all scores."""
    from ..storage import written

    by_score = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg"))
    runs = written(by_score.repartitionByRange(F.desc("s")).withColumn("run", F.spark_partition_id()), "scores")
    ahead = W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)  # over partitions, not rows
    starts = runs.groupBy("run").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn")).select(
        "run", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c + "0") for c in ("rp", "rn")])
    totals = runs.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    here = W.partitionBy("run").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0)
    c = (runs.join(starts, "run")
         .withColumns({"tp": F.sum("pos").over(here) + F.col("rp0"), "fp": F.sum("neg").over(here) + F.col("rn0")})
         .join(F.broadcast(totals)))  # one row
    roc = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2) / F.col("P")) / F.max("N")
    pr = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))) / F.max("P")
    return c.filter("P > 0 AND N > 0").agg(roc.alias("auc_roc"), pr.alias("auc_pr"))
