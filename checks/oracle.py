"""DuckDB statements with the results the registered queries must give.

They follow the definitions directly (window functions over whole series, a pairwise
sum for the exponential mean, islands for the alert levels) and share no code with the
Spark side but the constants.
"""

from __future__ import annotations

from weir.config import CAUSE_TEXT, CAUSES, LAGS, LIMITS, SENSORS, SPANS, WINDOWS
from weir.operators.diagnosis import RULES

EXPLAIN = {r.cause: r.explanation for r in RULES}

_J = "(((event_id * {}) % 101) / 100.0e0 - 0.5e0)"
J = {k: _J.format(k) for k in (7, 11, 13, 17, 19, 23, 29, 31, 37)}

READINGS = f"""
b AS (SELECT event_id, ts, user_id % 5 AS site_id,
  CAST(row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) - 1 AS BIGINT) AS seq FROM events),
p AS (SELECT *, seq % 200 AS ph_, CASE
  WHEN seq%200 BETWEEN 20 AND 44 THEN 'disinfectant_decay'
  WHEN seq%200 BETWEEN 60 AND 84 THEN 'contamination_intrusion'
  WHEN seq%200 BETWEEN 100 AND 119 THEN 'pipe_corrosion'
  WHEN seq%200 BETWEEN 130 AND 149 THEN 'stagnation'
  WHEN seq%200 BETWEEN 160 AND 184 THEN 'sensor_fault'
  WHEN seq%200 BETWEEN 190 AND 199 THEN 'operational_change' ELSE 'normal' END AS event_type FROM b),
q AS (SELECT *, CASE event_type WHEN 'disinfectant_decay' THEN (ph_-20)/24.0e0
  WHEN 'contamination_intrusion' THEN CASE WHEN ph_<=72 THEN (ph_-60)/12.0e0 ELSE 1.0e0-0.6e0*(ph_-72)/12.0e0 END
  WHEN 'pipe_corrosion' THEN (ph_-100)/19.0e0 WHEN 'stagnation' THEN (ph_-130)/19.0e0
  WHEN 'operational_change' THEN 1.0e0 ELSE 0.0e0 END AS ramp FROM p),
r AS (SELECT event_id, ts, 'S'||cast(site_id as varchar) AS site, seq, event_type,
 CAST(CASE WHEN event_type='sensor_fault' THEN 7.4e0 ELSE 7.4e0+0.6e0*{J[7]} - (CASE event_type WHEN 'pipe_corrosion' THEN 2.4e0 WHEN 'contamination_intrusion' THEN 3.0e0 ELSE 0 END)*ramp END AS DOUBLE) AS ph,
 CAST(180+60*{J[11]} + (CASE event_type WHEN 'pipe_corrosion' THEN 80 ELSE 0 END)*ramp AS DOUBLE) AS hardness,
 CAST(350+120*{J[13]} AS DOUBLE) AS tds,
 CAST(CASE WHEN event_id % 97 = 5 THEN NULL ELSE (2.4e0+0.8e0*{J[17]}) * (1 - (CASE event_type WHEN 'disinfectant_decay' THEN 0.93e0 WHEN 'stagnation' THEN 0.9e0 ELSE 0 END)*ramp) + (CASE event_type WHEN 'contamination_intrusion' THEN 5 WHEN 'operational_change' THEN 2.2e0 ELSE 0 END)*ramp END AS DOUBLE) AS chloramine,
 CAST(150+60*{J[19]} AS DOUBLE) AS sulfate,
 CAST(420+80*{J[23]} + (CASE event_type WHEN 'contamination_intrusion' THEN 1200 WHEN 'pipe_corrosion' THEN 100 ELSE 0 END)*ramp AS DOUBLE) AS conductivity,
 CAST(2.5e0+1.0e0*{J[29]} + (CASE event_type WHEN 'contamination_intrusion' THEN 9 ELSE 0 END)*ramp AS DOUBLE) AS organic_carbon,
 CAST((50+16*{J[31]}) * (1+(CASE event_type WHEN 'disinfectant_decay' THEN 1.2e0 WHEN 'contamination_intrusion' THEN 2.0e0 ELSE 0 END)*ramp) AS DOUBLE) AS thm,
 CAST(2.0e0+0.8e0*{J[37]} + (CASE event_type WHEN 'contamination_intrusion' THEN 6 WHEN 'stagnation' THEN 0.8e0 ELSE 0 END)*ramp AS DOUBLE) AS turbidity,
 CASE WHEN event_type IN ('normal','sensor_fault','operational_change') THEN 1 ELSE 0 END AS potability
FROM q)"""


MEASURED = """
m AS (SELECT event_id, ts, 'S' || CAST(user_id % 5 AS VARCHAR) AS site, event_type AS kind, value,
  CAST(row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) - 1 AS BIGINT) AS seq FROM events),
r AS (SELECT event_id, ts, site, seq,
 CASE kind WHEN 'error' THEN 'sensor_fault' WHEN 'purchase' THEN 'operational_change' WHEN 'view' THEN 'stagnation' ELSE 'normal' END AS event_type,
 CASE WHEN kind <> 'view' THEN 5.5e0 + 0.02e0 * value END AS ph,
 CASE WHEN kind IN ('signup', 'click', 'error') THEN 120 + value END AS hardness,
 300 + 2 * value AS tds,
 CASE WHEN kind <> 'error' THEN 3 - 0.02e0 * value END AS chloramine,
 CASE WHEN kind IN ('purchase', 'view') THEN 100 + value END AS sulfate,
 350 + 4 * value AS conductivity,
 1 + 0.05e0 * value AS organic_carbon,
 CASE WHEN kind <> 'signup' THEN 30 + 0.9e0 * value END AS thm,
 0.5e0 + 0.06e0 * value AS turbidity,
 CASE WHEN value < 100 THEN 1 ELSE 0 END AS potability FROM m)"""


# Arrivals by slice. A slice is judged by the watermark of the slice before it: the newest time of the
# slices before that one, less an hour, in whole milliseconds.
ALIVE = """
ne AS (SELECT count(*) AS n FROM events),
ar AS (SELECT event_id, ts, user_id, event_type, value, CAST(least(floor((event_id + CASE WHEN event_id % 13 = 4 THEN n / 5.0e0 WHEN event_id % 7 = 2 THEN n / 400.0e0
    ELSE 0.0e0 END + again * n / 30.0e0) * 8 / n), 9) AS INTEGER) AS arrival
  FROM events, ne, (VALUES (0), (1)) t(again) WHERE again = 0 OR event_id % 17 = 3),
tops AS (SELECT arrival, max(epoch_ms(ts)) AS top FROM ar GROUP BY arrival),
marks AS (SELECT a.arrival, max(b.top) - 3600000 AS mark FROM tops a LEFT JOIN tops b ON b.arrival <= a.arrival - 2 GROUP BY a.arrival),
alive AS (SELECT DISTINCT event_id, ts, user_id, event_type, value FROM ar JOIN marks USING (arrival) WHERE mark IS NULL OR epoch_us(ts) > mark * 1000)"""


def num(x: float) -> str:
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def r6(expr: str, name: str | None = None, d: int = 6) -> str:
    return f"round({expr}, {d}) + 0.0e0 AS {name or expr}"


def single(expr: str, name: str) -> str:
    """At single precision: means of few-digit values often lie exactly between two 6-digit decimals."""
    return f"CAST(CAST({expr} AS FLOAT) AS DOUBLE) AS {name}"


def shown(expr: str, name: str) -> str:
    return single(expr, name) if name.endswith("_mean") else r6(expr, name)


def r6s(cols) -> str:
    return ", ".join(r6(c) for c in cols)


def score(s: str) -> str:
    m = LIMITS[s]
    lo, hi, mid, half = map(num, (m.low, m.high, m.mid, m.half))
    return (f"CASE WHEN {s} IS NULL THEN 0.0e0 WHEN {s} BETWEEN {lo} AND {hi} THEN least(30.0e0*abs({s}-{mid})/{half}, 30.0e0) "
            f"WHEN {s} < {lo} THEN least(30.0e0+70.0e0*({lo}-{s})/{half}, 100.0e0) "
            f"ELSE least(30.0e0+70.0e0*({s}-{hi})/{half}, 100.0e0) END")


TOTAL = " + ".join(f"(CASE WHEN {s} IS NULL THEN 0.0e0 ELSE {num(m.weight)} * ({score(s)}) END)" for s, m in LIMITS.items())
WEIGHT = " + ".join(f"(CASE WHEN {s} IS NULL THEN 0.0e0 ELSE {num(m.weight)} END)" for s, m in LIMITS.items())


def raw(src: str = "r") -> str:
    return f"raw AS (SELECT *, CASE WHEN {WEIGHT} > 0 THEN ({TOTAL}) / ({WEIGHT}) ELSE 0.0e0 END AS risk_raw FROM {src})"


def pairs(src: str) -> str:
    """Each row with the rows of its own and the three blocks before: beyond that a weight
    is below 1e-27 and cannot show."""
    return (f"FROM (SELECT *, seq // 256 AS blk FROM {src}) a CROSS JOIN range(4) t(k) "
            f"JOIN (SELECT *, seq // 256 AS blk FROM {src}) o ON o.site = a.site AND o.blk = a.blk - t.k AND o.seq <= a.seq")


def smooth(src: str = "raw", span: int = 6) -> str:
    q = f"pow({num(1 - 2 / (span + 1))}, a.seq - o.seq)"
    return (f"sm AS (SELECT a.site, a.seq, least(greatest(sum({q} * o.risk_raw) / sum({q}), 0), 100) AS risk "
            f"{pairs(src)} GROUP BY a.site, a.seq), "
            f"risk AS (SELECT raw.*, sm.risk FROM {src} raw JOIN sm USING (site, seq))")


ALERTS = """
f1 AS (SELECT *, count(CASE WHEN risk >= 65 THEN 1 END) OVER w3 = 3 AS wok, count(CASE WHEN risk >= 80 THEN 1 END) OVER w3 = 3 AS cok
  FROM risk WINDOW w3 AS (PARTITION BY site ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
f2 AS (SELECT *, CASE WHEN cok THEN 'C' WHEN risk < 60 THEN 'N' WHEN wok AND risk < 75 THEN 'W' END AS reset FROM f1),
f3 AS (SELECT *, CASE WHEN reset IS NULL AND wok THEN seq END AS ea,
  CASE WHEN reset IS NULL AND NOT wok AND risk >= 65 AND risk < 75 THEN seq END AS eb,
  CASE WHEN reset IS NULL AND risk >= 60 AND risk < 65 THEN seq END AS ed,
  count(reset) OVER (PARTITION BY site ORDER BY seq) AS isl FROM f2),
f4 AS (SELECT *, coalesce(max(reset) OVER (PARTITION BY site, isl), 'N') AS base, max(ea) OVER u AS last_a,
  min(eb) OVER u AS first_b, min(ed) OVER u AS first_d FROM f3
  WINDOW u AS (PARTITION BY site, isl ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f5 AS (SELECT *, CASE base WHEN 'W' THEN 'warning'
  WHEN 'N' THEN CASE WHEN last_a IS NOT NULL THEN 'warning' ELSE 'normal' END
  ELSE CASE WHEN first_b IS NULL AND first_d IS NULL THEN 'critical'
       WHEN first_b < coalesce(first_d, first_b + 1) THEN 'warning'
       WHEN last_a > first_d THEN 'warning' ELSE 'normal' END END AS alert_level FROM f4),
al AS (SELECT *, coalesce(lag(alert_level) OVER (PARTITION BY site ORDER BY seq), 'normal') AS previous_level,
  alert_level <> coalesce(lag(alert_level) OVER (PARTITION BY site ORDER BY seq), 'normal') AS alert_changed,
  lag(ts) OVER (PARTITION BY site ORDER BY seq) AS prev_ts,
  max(seq) OVER (PARTITION BY site) + 1 AS n_rows FROM f5),
lg AS (SELECT * FROM al WHERE seq = 0 OR alert_changed)"""

EVENTS = """
e1 AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY site ORDER BY seq) OR seq = 0 THEN seq END AS st FROM al),
e2 AS (SELECT *, max(st) OVER (PARTITION BY site ORDER BY seq) AS event_start FROM e1),
ld AS (SELECT site, event_start, event_type, min(ts) AS onset, min(CASE WHEN alert_level <> 'normal' THEN ts END) AS first_alert,
  count(*) AS n_readings FROM e2 WHERE event_type <> 'normal' GROUP BY ALL),
lt AS (SELECT *, epoch_us(first_alert) - epoch_us(onset) AS lead_us FROM ld)"""

WITH_R = f"WITH {READINGS}"
WITH_RAW = f"{WITH_R}, {raw()}"
WITH_RISK = f"{WITH_RAW}, {smooth()}"
WITH_AL = f"{WITH_RISK}, {ALERTS}"
WITH_EV = f"{WITH_AL}, {EVENTS}"


def sliced(n: int) -> str:
    """Readings cut to the last n per site and renumbered."""
    return (f"{WITH_R}, sl AS (SELECT * REPLACE (CAST(seq - greatest(sz - {n}, 0) AS BIGINT) AS seq) FROM "
            f"(SELECT *, count(*) OVER (PARTITION BY site) AS sz FROM r) WHERE seq >= sz - {n}), {raw('sl')}, {smooth()}")


def level(x: str) -> str:
    return (f"CASE WHEN {x} >= 80 THEN 'critical' WHEN {x} >= 65 THEN 'warning' WHEN {x} >= 50 THEN 'caution' "
            f"WHEN {x} >= 30 THEN 'normal' ELSE 'excellent' END")


def w(n: int) -> str:
    return f"OVER (PARTITION BY site ORDER BY seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


S = "OVER (PARTITION BY site ORDER BY seq)"

ROLLING = {f"{s}_w{n}_{k}": e for s in SENSORS for n in WINDOWS for k, e in (
    ("mean", f"avg({s}) {w(n)}"), ("std", f"coalesce(stddev_samp({s}) {w(n)}, 0)"), ("min", f"min({s}) {w(n)}"),
    ("max", f"max({s}) {w(n)}"), ("range", f"max({s}) {w(n)} - min({s}) {w(n)}"))}
DIFFS = {f"{s}_diff{k}": f"coalesce({s} - lag({s}, {k}) {S}, 0)" for s in SENSORS for k in (1, 3)}
STUCK = {f"{s}_stuck": f"CASE WHEN coalesce(stddev_samp({s}) {w(12)}, 0) < 1e-6 THEN 1 ELSE 0 END" for s in SENSORS}
SHIFT = {f"{s}_lag{k}": f"lag({s}, {k}) {S}" for s in SENSORS for k in LAGS}
TIME = {
    "hour_sin": "sin(2*pi()*(hour(ts)+minute(ts)/60.0e0)/24)", "hour_cos": "cos(2*pi()*(hour(ts)+minute(ts)/60.0e0)/24)",
    "dow_sin": "sin(2*pi()*(isodow(ts)-1)/7)", "dow_cos": "cos(2*pi()*(isodow(ts)-1)/7)"}
NIGHT = "CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 1 ELSE 0 END"
RATIO = {"chlor_turb_ratio": "chloramine/(turbidity+0.01e0)", "cond_tds_ratio": "conductivity/(tds+1)",
         "ph_hardness_ratio": "ph/(hardness+1)", "oc_thm_ratio": "organic_carbon/(thm+0.01e0)"}


def ewma_cte(sensors=SENSORS, spans=SPANS) -> str:
    sel = []
    for sp in spans:
        q = f"pow({num(1 - 2 / (sp + 1))}, a.seq - o.seq)"
        sel += [f"sum({q} * o.{s}) / sum(CASE WHEN o.{s} IS NOT NULL THEN {q} END) AS {s}_ewma_{sp}" for s in sensors]
    return f"ew AS (SELECT a.site, a.seq, {', '.join(sel)} {pairs('r')} GROUP BY a.site, a.seq)"


EWMA = [f"{s}_ewma_{sp}" for s in SENSORS for sp in SPANS]
BACK = "OVER (PARTITION BY site ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
LAGGED = (f"sh AS (SELECT *, {', '.join(f'{e} AS x_{k}' for k, e in SHIFT.items())} FROM r), "
          f"lgd AS (SELECT *, {', '.join(f'last_value(x_{k} IGNORE NULLS) {BACK} AS {k}' for k in SHIFT)} FROM sh)")

FEATURES = [*ROLLING, *EWMA, *DIFFS, *SHIFT, *TIME, *RATIO]


def rule_cte(src: str = "r") -> str:
    return f"""fe AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in {**DIFFS, **STUCK}.items() if k.split('_')[0] in ('ph', 'chloramine', 'conductivity', 'turbidity'))} FROM {src})"""


HITS = {
    "sensor_fault": ("ph_stuck = 1 OR conductivity_stuck = 1 OR chloramine_stuck = 1", 0.9),
    "disinfectant_decay": ("chloramine < 0.2e0*1.5e0 AND thm > 80.0e0*0.7e0", 0.85),
    "contamination_intrusion": ("turbidity > 4.0e0*0.8e0 AND conductivity > 800.0e0*0.6e0", 0.8),
    "pipe_corrosion": ("ph < 6.5e0 AND hardness > 220", 0.75),
    "stagnation": ("chloramine < 0.2e0*2.0e0 AND turbidity_diff1 > 0 AND chloramine_diff1 < 0", 0.7),
    "operational_change": ("abs(chloramine_diff3) > 1.5e0 AND turbidity < 4.0e0", 0.65),
}
RAW_HITS = {k: HITS[k] for k in ("disinfectant_decay", "contamination_intrusion", "pipe_corrosion")}


def hit_text(hits) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{k}:{v}' END" for k, (c, v) in hits.items()) + ")"


def primary(hits) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, (c, _) in hits.items()) + " ELSE 'normal' END"


def confidence(hits) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {num(v * 0.5)}" for k, (c, v) in hits.items()) + " ELSE 1.0e0 END"


def ranked(hits, src: str) -> str:
    arms = " UNION ALL ".join(f"SELECT site, seq, '{k}' AS cause, round({num(v * 0.5)}, 3) AS score FROM {src} WHERE {c}"
                              for k, (c, v) in hits.items())
    return (f"SELECT site, seq, CAST(row_number() OVER (PARTITION BY site, seq ORDER BY score DESC) AS INTEGER) AS rank, "
            f"cause, score FROM ({arms})")


def label(c: str) -> str:
    return f"array_to_string([upper(x[1]) || x[2:] for x in string_split({c}, '_')], ' ')"


def lookup(c: str, table: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + " END"


def breakdown() -> str:
    arms = " UNION ALL ".join(
        f"SELECT site, ts, seq, '{s}' AS sensor, {r6(s, 'value')}, {r6(score(s), 'deviation_score')}, {num(m.weight)} AS weight, "
        f"{r6(num(m.weight) + '*(' + score(s) + ')', 'contribution')}, '{m.unit}' AS unit, '{m.label}' AS safe_range, "
        f"printf('%.2f', {s}) || ' {m.unit}' AS value_text FROM r WHERE {s} IS NOT NULL"
        for s, m in LIMITS.items())
    return f"{WITH_R} {arms}"


def breaches() -> str:
    arms = " UNION ALL ".join(
        f"SELECT site, ts, seq, '{s}' AS sensor, {r6(s, 'value')}, {num(m.low)} AS low, {num(m.high)} AS high, '{m.unit}' AS unit "
        f"FROM r WHERE {s} < {num(m.low)} OR {s} > {num(m.high)}" for s, m in LIMITS.items())
    return f"{WITH_R} {arms}"


def profile() -> str:
    arms = " UNION ALL ".join(
        f"SELECT '{s}' AS sensor, {r6(f'avg({s})', 'mean')}, {r6(f'stddev_samp({s})', 'std')}, {r6(f'min({s})', 'min')}, "
        f"{r6(f'max({s})', 'max')}, count(*) - count({s}) AS n_null, count(*) AS n_rows, "
        f"{num(LIMITS[s].high)} < 3 * max({s}) AS limit_in_view FROM r" for s in SENSORS)
    return f"{WITH_R} {arms}"


def clipped() -> str:
    return ", ".join(r6(f"CASE WHEN {s} IS NOT NULL THEN least(greatest({s}, {num(0.5 * m.low)}), {num(1.5 * m.high)}) END", s)
                     for s, m in LIMITS.items())


DIURNAL = "(1 + 0.08e0*sin(2*pi()*(hour(ts)+minute(ts)/60.0e0-7)/24) + 0.04e0*sin(4*pi()*(hour(ts)+minute(ts)/60.0e0-7)/24))"


def overlay() -> str:
    """Scenarios as registered: one of five types in turn at every 97th reading + 31, overlapping by design."""
    ramp = ("CASE WHEN type = 'contamination_intrusion' THEN CASE WHEN i < n//2 THEN CASE WHEN n//2 > 1 THEN i/(n//2-1.0e0) ELSE 0 END "
            "ELSE CASE WHEN n - n//2 > 1 THEN 1.0e0 - 0.4e0*(i - n//2)/(n - n//2 - 1.0e0) ELSE 1.0e0 END END "
            "WHEN type = 'sensor_fault' THEN 0.0e0 WHEN n > 1 THEN i/(n-1.0e0) ELSE 0.0e0 END")
    return f"""{WITH_R}, sz AS (SELECT site, max(seq)+1 AS n_rows FROM r GROUP BY site),
 sc AS (SELECT site, seq AS s, ph AS held, ['disinfectant_decay','contamination_intrusion','pipe_corrosion','stagnation','sensor_fault'][(seq//97)%5+1] AS type,
   [60,40,80,100,50][(seq//97)%5+1] AS d FROM r WHERE seq % 97 = 31),
 fx AS (SELECT r.site, r.seq, sc.s, type, held, r.seq - sc.s AS i, least(d, n_rows - sc.s) AS n
   FROM r JOIN sz USING (site) JOIN sc ON sc.site = r.site AND r.seq >= sc.s AND r.seq < sc.s + least(d, n_rows - sc.s)),
 fr AS (SELECT *, {ramp} AS g FROM fx),
 lf AS (SELECT site, seq, max(CASE WHEN type = 'sensor_fault' THEN s END) AS fs FROM fr GROUP BY site, seq),
 ag AS (SELECT fr.site, fr.seq, max_by(type, s) AS type,
   product(CASE type WHEN 'disinfectant_decay' THEN 1-0.7e0*g WHEN 'stagnation' THEN 1-0.5e0*g ELSE 1 END) AS xc,
   product(CASE type WHEN 'disinfectant_decay' THEN 1+0.8e0*g ELSE 1 END) AS xt,
   sum(CASE type WHEN 'contamination_intrusion' THEN 3.0e0*g WHEN 'stagnation' THEN 0.8e0*g ELSE 0 END) AS pt,
   sum(CASE type WHEN 'contamination_intrusion' THEN 200.0e0*g WHEN 'pipe_corrosion' THEN 100.0e0*g ELSE 0 END) AS pc,
   sum(CASE type WHEN 'contamination_intrusion' THEN 5.0e0*g ELSE 0 END) AS po,
   sum(CASE WHEN type = 'pipe_corrosion' AND (lf.fs IS NULL OR s > lf.fs) THEN -1.5e0*g ELSE 0 END) AS pp,
   sum(CASE type WHEN 'pipe_corrosion' THEN 40.0e0*g ELSE 0 END) AS hh,
   max_by(held, s) FILTER (type = 'sensor_fault') AS held, bool_or(type <> 'sensor_fault') AS unsafe
   FROM fr JOIN lf USING (site, seq) GROUP BY fr.site, fr.seq)
 SELECT site, seq, coalesce(ag.type, event_type) AS event_type, CASE WHEN unsafe THEN 0 ELSE potability END AS potability,
  {r6('coalesce(held, ph) + coalesce(pp, 0)', 'ph')}, {r6('hardness + coalesce(hh, 0)', 'hardness')}, {r6('chloramine * coalesce(xc, 1)', 'chloramine')},
  {r6('thm * coalesce(xt, 1)', 'thm')}, {r6('turbidity + coalesce(pt, 0)', 'turbidity')}, {r6('conductivity + coalesce(pc, 0)', 'conductivity')},
  {r6('organic_carbon + coalesce(po, 0)', 'organic_carbon')} FROM r LEFT JOIN ag USING (site, seq)"""


# rows of the feature frame: all sensors and lags present (a mean is there once its sensor is)
FRAME = (f"{WITH_R}, {LAGGED}, fr AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY seq) - 1 AS pos, "
         f"count(*) OVER (PARTITION BY site) AS sz FROM lgd WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*SENSORS, *SHIFT])})")
TARGETS = ", ".join(f"lead({s}, 12) {{over}} AS target_{s}" for s in SENSORS)


def trends() -> str:
    arms = " UNION ALL ".join(
        f"SELECT site, ts, seq, '{s}' AS sensor, {r6(s, 'value')}, {num(m.low)} AS low, {num(m.high)} AS high, '{m.unit}' AS unit, "
        f"NOT ({s} BETWEEN {num(m.low)} AND {num(m.high)}) AS outside FROM r" for s, m in LIMITS.items())
    return f"{WITH_R} {arms}"


def contributions() -> str:
    arms = " UNION ALL ".join(f"SELECT site, seq, '{s}' AS sensor, {num(m.weight)}*({score(s)}) AS c FROM nw WHERE {s} IS NOT NULL" for s, m in LIMITS.items())
    return (f"{WITH_R}, nw AS (SELECT * FROM r QUALIFY seq = max(seq) OVER (PARTITION BY site)) SELECT site, seq, "
            f"CAST(row_number() OVER (PARTITION BY site ORDER BY c DESC, sensor) AS INTEGER) AS rank, sensor, {r6('c', 'contribution')} FROM ({arms})")


def captions() -> str:
    arms = " UNION ALL ".join(f"SELECT site, seq, left({label(repr(s))}, 10) AS caption, printf('%.1f', {s}) AS text FROM r WHERE {s} IS NOT NULL" for s in SENSORS)
    return f"{WITH_R} {arms}"


def naive_errors() -> str:
    arms = " UNION ALL ".join(f"SELECT '{s}' AS sensor, {r6(f'avg(abs(target_{s} - {s}))', 'naive_mae')}, count(target_{s}) AS n_rows FROM tg WHERE pos >= floor(0.75e0 * sz)" for s in SENSORS)
    return f"{FRAME}, tg AS (SELECT *, {TARGETS.format(over='OVER (PARTITION BY site ORDER BY pos)')} FROM fr) {arms}"


RESID = (f"rs AS (SELECT site, ts, seq, {', '.join(f'abs({s} - lag({s}, 12) {S}) AS {s}' for s in SENSORS)} FROM r), "
         "rl AS (" + " UNION ALL ".join(f"SELECT site, ts, seq, '{s}' AS sensor, {s} AS residual FROM rs" for s in SENSORS) + "), "
         "rz AS (SELECT *, (residual - avg(residual) OVER z) / nullif(stddev_samp(residual) OVER z, 0) AS z FROM rl "
         "WHERE residual IS NOT NULL WINDOW z AS (PARTITION BY site, sensor))")

REPORT = f"""{WITH_R}, {rule_cte()}, pl AS (SELECT event_type AS t, {primary(HITS)} AS p FROM fe)"""


def statements() -> dict[str, str]:
    ids = "site, seq"
    msg = lambda s: f"CAST(printf('%.3f', {s}) AS DOUBLE)"
    q = {
        "scan_readings": f"{WITH_R} SELECT event_id, site, seq, ts, event_type, potability, {r6s(SENSORS)} FROM r WHERE site IN ('S1', 'S3')",
        "time_encodings": f"{WITH_R} SELECT {ids}, {', '.join(r6(e, k) for k, e in TIME.items())}, {NIGHT} AS is_night FROM r",
        "sensor_ratios": f"{WITH_R} SELECT {ids}, {', '.join(r6(e, k) for k, e in RATIO.items())} FROM r",
        "deviation_scores": f"{WITH_R} SELECT {ids}, {', '.join(r6(score(s), s) for s in LIMITS)} FROM r",
        "risk_raw": f"{WITH_RAW} SELECT {ids}, {r6('risk_raw')} FROM raw",
        "risk_series": f"{WITH_RISK} SELECT {ids}, ts, event_type, {r6('risk_raw')}, {r6('risk')} FROM risk",
        "risk_levels": f"{WITH_RISK} SELECT {ids}, {level('risk')} AS risk_level FROM risk",
        "risk_breakdown": breakdown(),
        "score_readings": f"{WITH_RAW} SELECT {ids}, {r6('risk_raw', 'risk_index')}, {level('risk_raw')} AS risk_level, "
                          f"{r6('greatest(0, 1 - risk_raw/100)', 'potability_probability')}, greatest(0, 1 - risk_raw/100) > 0.5e0 AS potable, "
                          f"{primary(RAW_HITS)} AS primary_cause, {confidence(RAW_HITS)} AS cause_confidence FROM raw",
        "clip_readings": f"{WITH_R} SELECT {ids}, {clipped()} FROM r",
        "diurnal_adjust": f"{WITH_R} SELECT {ids}, " + ", ".join(
            r6(f"{s} / {DIURNAL}", f"{s}_adj") for s in ("chloramine", "turbidity", "conductivity", "ph")) + " FROM r",
        "cause_labels": f"{WITH_R} SELECT {ids}, event_type, {label('event_type')} AS label, left({label('event_type')}, 10) AS short_label, "
                        f"{lookup('event_type', CAUSE_TEXT)} AS description, "
                        f"CASE event_type {' '.join(f'''WHEN '{c}' THEN {i}''' for i, c in enumerate(CAUSES))} ELSE 0 END AS class_index FROM r",
        "last_n_readings": f"{sliced(288)} SELECT site, seq, event_id, ts FROM sl",
        "limit_breaches": breaches(),
        "event_counts": f"{WITH_R} SELECT event_type, count(*) AS n FROM r WHERE event_type <> 'normal' GROUP BY event_type",
        "rolling_stats": f"{WITH_R} SELECT {ids}, {', '.join(shown(e, k) for k, e in ROLLING.items())} FROM r",
        "ewma": f"{WITH_R}, {ewma_cte()} SELECT {ids}, {r6s(EWMA)} FROM ew",
        "diffs": f"{WITH_R} SELECT {ids}, {', '.join(r6(e, k) for k, e in DIFFS.items())} FROM r",
        "lags": f"{WITH_R}, {LAGGED} SELECT {ids}, {r6s(SHIFT)} FROM lgd",
        "stuck_sensors": f"{WITH_R} SELECT {ids}, {', '.join(f'{e} AS {k}' for k, e in STUCK.items())} FROM r",
        "build_features": f"{WITH_R}, {ewma_cte()}, {LAGGED}, "
                          f"ft AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in {**ROLLING, **DIFFS, **STUCK, **TIME, **RATIO}.items())}, {NIGHT} AS is_night FROM lgd) "
                          f"SELECT site, seq, event_type, potability, is_night, {', '.join(STUCK)}, {', '.join(shown(c, c) for c in [*SENSORS, *FEATURES])} "
                          f"FROM ft JOIN ew USING (site, seq) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*SENSORS, *EWMA, *SHIFT])}",
        "alert_states": f"{WITH_AL} SELECT {ids}, {r6('risk')}, alert_level, alert_changed FROM al",
        "alert_log": f"{WITH_AL} SELECT {ids}, ts, alert_level, {r6('risk')}, event_type FROM lg",
        "alert_summary": f"{WITH_AL} SELECT site, count(*) FILTER (alert_level = 'warning') AS n_warning, "
                         "count(*) FILTER (alert_level = 'critical') AS n_critical, count(*) AS n_readings FROM al GROUP BY site",
        "alert_stats": f"{WITH_AL} SELECT site, count(*) FILTER (alert_level <> 'normal') AS total_alerts, "
                       "count(*) FILTER (alert_level = 'critical') AS critical_alerts, count(*) FILTER (alert_level = 'warning') AS warnings, "
                       "count(*) FILTER (alert_level <> 'normal' AND event_type = 'normal') AS false_alarms FROM lg GROUP BY site",
        "forecast_target": f"{WITH_R}, t AS (SELECT *, {TARGETS.format(over=S)} FROM r) SELECT {ids}, {r6s(SENSORS)}, {r6s([f'target_{s}' for s in SENSORS])} FROM t",
        "first_n_readings": f"{WITH_R} SELECT {ids}, event_id, ts FROM r WHERE seq < 25",
        "latest_contributions": contributions(),
        "sensor_trends": trends(),
        "feed_labels": captions(),
        "class_balance": f"{WITH_R} SELECT potability, count(*) AS n, {r6('count(*) * 1.0e0 / sum(count(*)) OVER ()', 'share')} FROM r GROUP BY potability",
        "union_of_sites": f"{WITH_R} SELECT {ids}, {r6('ph')}, CASE WHEN site <> 'S4' THEN round(turbidity, 6) END AS turbidity FROM r",
        "parsed_times": f"{WITH_R} SELECT {ids}, ts FROM r",
        "risk_rank_metrics": f"""{WITH_RAW}, g AS (SELECT round(1 - risk_raw / 100, 6) AS s, sum(potability) AS p, sum(1 - potability) AS n FROM raw GROUP BY 1),
 c AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM g)
 SELECT {r6('sum(n * (tp - p / 2.0e0) / np) / max(nn)', 'auc_roc', 9)}, {r6('sum(p * (tp * 1.0e0 / (tp + fp))) / max(np)', 'auc_pr', 9)} FROM c""",
        "lags_of_slice": f"{WITH_R}, r2 AS (SELECT * FROM r WHERE seq >= 100), {LAGGED.replace('FROM r)', 'FROM r2)')} SELECT {ids}, {r6s(SHIFT)} FROM lgd",
        "alert_log_of_slice": f"{WITH_R}, sl AS (SELECT * REPLACE (CAST(seq - 100 AS BIGINT) AS seq) FROM r WHERE seq >= 100), {raw('sl')}, {smooth()}, {ALERTS} "
                              f"SELECT site, seq + 100 AS seq, ts, alert_level, {r6('risk')}, event_type FROM lg",
        "blocked_split_features": f"{FRAME}, n AS (SELECT *, sz // 4 AS blk FROM fr) SELECT {ids}, CAST(f AS INTEGER) AS fold, "
                                  "CASE WHEN pos < blk * f THEN 'train' ELSE 'validate' END AS role FROM n CROSS JOIN range(1, 4) t(f) WHERE pos < blk * (f + 1)",
        "ordered_split_features": f"{FRAME} SELECT {ids}, CASE WHEN pos < floor(0.75e0 * sz) THEN 'train' ELSE 'validate' END AS role FROM fr",
        "forecast_targets_features": f"{FRAME}, tg AS (SELECT *, {TARGETS.format(over='OVER (PARTITION BY site ORDER BY pos)')} FROM fr) SELECT {ids}, {r6s([f'target_{s}' for s in SENSORS])} FROM tg",
        "naive_forecast_mae": naive_errors(),
        "cause_confusion_totals": f"{FRAME} SELECT event_type, count(*) AS n FROM fr GROUP BY event_type",
        "importance_summary": "SELECT CAST(279 AS BIGINT) AS n_features, 1.0e0 AS total, CAST(279 AS BIGINT) AS n_names",
        "model_save_load": f"{FRAME} SELECT {ids}, TRUE AS same FROM fr",
        "blocked_split": f"{WITH_R}, n AS (SELECT *, count(*) OVER (PARTITION BY site) // 4 AS blk FROM r) SELECT {ids}, CAST(f AS INTEGER) AS fold, "
                         "CASE WHEN seq < blk * f THEN 'train' ELSE 'validate' END AS role FROM n CROSS JOIN range(1, 4) t(f) WHERE seq < blk * (f + 1)",
        "ordered_split": f"{WITH_R} SELECT {ids}, CASE WHEN seq < floor(0.75e0 * count(*) OVER (PARTITION BY site)) THEN 'train' ELSE 'validate' END AS role FROM r",
        "ordered_split_global": f"{WITH_R} SELECT {ids}, CASE WHEN row_number() OVER (ORDER BY site, seq) <= floor(0.75e0 * count(*) OVER ()) THEN 'train' ELSE 'validate' END AS role FROM r",
        "sensor_profile": profile(),
        "classification_report": f"""{REPORT}, c AS (SELECT DISTINCT class FROM (SELECT t AS class FROM pl UNION ALL SELECT p FROM pl)),
 m AS (SELECT class, (SELECT count(*) FROM pl WHERE p = class AND t = class) AS tp, (SELECT count(*) FROM pl WHERE p = class) AS np,
   (SELECT count(*) FROM pl WHERE t = class) AS support FROM c)
 SELECT class, round(CASE WHEN np > 0 THEN tp*1.0e0/np ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp*1.0e0/support ELSE 0 END, 6) AS recall,
   round(CASE WHEN np + support > 0 THEN 2.0e0*tp/(np+support) ELSE 0 END, 6) AS f1, support FROM m""",
        "rule_hits": f"{WITH_R}, {rule_cte()} SELECT {ids}, {hit_text(HITS)} AS hits FROM fe",
        "rule_hits_raw": f"{WITH_R} SELECT {ids}, {hit_text(RAW_HITS)} AS hits FROM r",
        "hybrid_diagnosis": f"{WITH_R}, {rule_cte()} SELECT {ids}, {primary(HITS)} AS primary_cause, {confidence(HITS)} AS confidence FROM fe",
        "cause_ranking": f"{WITH_R}, {rule_cte()} {ranked(HITS, 'fe')}",
        "message_json": f"""{WITH_RAW} SELECT {ids}, '{{"timestamp":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","sensors":{{' || concat_ws(',', """
                        + ", ".join(f"""'"{s}":' || CAST({msg(s)} AS VARCHAR)""" for s in SENSORS)
                        + f""") || '}},"risk_index":' || CAST(CAST(printf('%.1f', risk_raw) AS DOUBLE) AS VARCHAR) || ',"event_type":"' || event_type || '","cause":{{"cause":"' || {primary(RAW_HITS)} || '"' || """
                        + "coalesce(" + lookup(primary(RAW_HITS), {k: f',"confidence":{v},"explanation":"{EXPLAIN[k]}","method":"rule"' for k, (_, v) in RAW_HITS.items()}) + ", '')"
                        + """ || '}}' AS message FROM raw""",
        "scenario_overlay": overlay(),
        "forecast_residuals": f"{WITH_R}, {RESID} SELECT site, seq, sensor, {r6('residual')}, {r6('z')} FROM rz",
        "clip_bounds": f"{WITH_R} SELECT {ids}, {r6('CASE WHEN ph < 0 THEN 0 WHEN ph > 14 THEN 14 ELSE ph END', 'ph')}, {r6('CASE WHEN turbidity < 0 THEN 0 ELSE turbidity END', 'turbidity')} FROM r",
        "ewma_impute": f"{WITH_R}, {ewma_cte(spans=(6,))} SELECT {ids}, " + ", ".join(r6(f"coalesce(r.{s}, ew.{s}_ewma_6)", s) for s in SENSORS) + " FROM r JOIN ew USING (site, seq)",
        "missing_flags": f"{WITH_R} " + " UNION ALL ".join(
            f"SELECT site, '{s}' AS sensor, {r6(f'1 - count({s}) / (count(*) * 1.0e0)', 'missing_share')}, 1 - count({s}) / (count(*) * 1.0e0) > 0.5e0 AS mostly_missing FROM r GROUP BY site" for s in SENSORS),
        "drift_flags": f"{WITH_R}, m AS (SELECT site, seq, {', '.join(f'avg({s}) {w(72)} AS {s}, coalesce(stddev_samp({s}) {w(72)}, 0) AS d_{s}' for s in SENSORS)} FROM r) SELECT {ids}, "
                       + ", ".join(f"coalesce(CAST(abs({s} - lag({s}, 72) {S}) > 2 * lag(d_{s}, 72) {S} AS INTEGER), 0) AS {s}_drift" for s in SENSORS) + " FROM m",
        "amplified_risk": f"{WITH_RISK}, {RESID}, za AS (SELECT site, seq, avg(greatest(z, 0)) AS z FROM rz GROUP BY site, seq) "
                          f"SELECT site, seq, {r6('risk')}, {r6('least(100, risk * (1 + 0.1e0 * coalesce(z, 0)))', 'amplified_risk')} FROM risk LEFT JOIN za USING (site, seq)",
        "lead_times": f"{WITH_EV} SELECT site, event_start, event_type, onset, first_alert, n_readings, lead_us FROM lt",
        "lead_time_histogram": f"{WITH_EV} SELECT event_type, CAST(least(floor(lead_us / 7200000000.0e0), 24) AS INTEGER) AS bucket, count(*) AS n_events FROM lt WHERE lead_us IS NOT NULL GROUP BY ALL",
        "false_alarms_per_day": f"""{WITH_EV}, a AS (SELECT site, count(*) FILTER (alert_level <> 'normal' AND event_type = 'normal') AS false_alarms FROM lg GROUP BY site),
 d AS (SELECT site, (max(epoch_us(ts)) - min(epoch_us(ts))) / 86400e6 AS days FROM al GROUP BY site), t AS (SELECT site, avg(lead_us) / 1e6 AS s FROM lt GROUP BY site)
 SELECT site, false_alarms, {r6('days')}, {r6('false_alarms / nullif(days, 0)', 'per_day')}, {r6('s', 'mean_detect_s', 3)} FROM a JOIN d USING (site) LEFT JOIN t USING (site)""",
        "confusion": f"{REPORT} SELECT t AS event_type, " + ", ".join(f"count(*) FILTER (p = '{c}') AS {c}" for c in CAUSES) + " FROM pl GROUP BY t",
        "risk_stability": f"{WITH_RISK} SELECT site, {r6('var_samp(risk)', 'risk_variance')}, count(*) AS n_readings FROM risk WHERE event_type = 'normal' GROUP BY site",
        "alert_episodes": f"""{WITH_AL}, ep AS (SELECT site, seq, alert_level, ts, lead(seq) {S} AS ns, lead(prev_ts) {S} AS nt, n_rows FROM lg), lt AS (SELECT site, max(ts) AS last_ts FROM al GROUP BY site)
 SELECT site, seq, alert_level, ts AS start_ts, coalesce(nt, last_ts) AS end_ts, coalesce(ns, n_rows) - seq AS n_readings, epoch_us(coalesce(nt, last_ts)) - epoch_us(ts) AS duration_us FROM ep JOIN lt USING (site)""",
        "episode_durations": f"""{WITH_AL}, g AS (SELECT *, sum(CASE WHEN seq = 0 OR alert_changed THEN 1 ELSE 0 END) {S} AS ep FROM al),
 e AS (SELECT site, ep, alert_level, count(*) AS n, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS s FROM g GROUP BY ALL)
 SELECT alert_level, count(*) AS n_episodes, {r6('avg(n)', 'avg_readings')}, {r6('avg(s)', 'avg_seconds', 3)} FROM e GROUP BY alert_level""",
        "pseudo_labels": f"{WITH_R}, {rule_cte()} SELECT {ids}, event_type, {primary(HITS)} AS pseudo_label FROM fe",
        "threshold_compare": f"""{WITH_AL}, x AS (SELECT *, coalesce(lag(risk_raw) {S}, 0) AS pr FROM al),
 y AS (SELECT site, count(*) FILTER (risk_raw >= 65 AND pr < 65) AS naive_alerts, count(*) FILTER (previous_level = 'normal' AND alert_level <> 'normal') AS raised_alerts FROM x GROUP BY site)
 SELECT *, {r6('1 - raised_alerts / nullif(naive_alerts * 1.0e0, 0)', 'reduction')} FROM y""",
    }
    for name, n in (("site_comparison", 50), ("site_comparison_24h", 288)):
        q[name] = (f"{sliced(n)} SELECT site, {r6('max_by(risk, seq)', 'current_risk')}, {r6('avg(risk)', 'avg_risk')}, {r6('max(risk)', 'max_risk')}, "
                   f"count(*) AS n_readings, upper({level('max_by(risk, seq)')}) AS status FROM risk GROUP BY site")
    q["raw_csv_profile"] = profile()
    q["partitioned_sink"] = f"{WITH_R} SELECT site, ts, event_type, potability, {r6s(SENSORS)} FROM r WHERE site IN ('S1', 'S3')"
    q["stream_scores"] = f"{WITH_RAW} SELECT {ids}, {r6('risk_raw', 'risk_index')}, {level('risk_raw')} AS risk_level, {primary(RAW_HITS)} AS cause FROM raw"
    q["stream_alerts"] = f"{WITH_AL} SELECT site, ts, {r6('risk')}, alert_level, alert_changed FROM al"
    q["stream_features"] = q["build_features"]
    q["data_table"] = (f"{sliced(288)}, {ALERTS} SELECT ts, site, {r6s(SENSORS)}, {r6('risk')}, alert_level, event_type FROM al WHERE seq >= n_rows - 200")
    q["latest_diagnosis"] = (
        f"{sliced(288)}, {ALERTS} SELECT site, ts, {r6('risk')}, {level('risk')} AS risk_level, alert_level, "
        f"CASE WHEN alert_level <> 'normal' THEN {primary(RAW_HITS)} END AS banner_cause, CASE WHEN alert_level <> 'normal' THEN {confidence(RAW_HITS)} END AS banner_confidence, "
        f"CASE WHEN alert_level = 'critical' THEN {lookup(primary(RAW_HITS), EXPLAIN)} END AS banner_evidence, "
        f"{primary(RAW_HITS)} AS primary_cause, {lookup(primary(RAW_HITS), CAUSE_TEXT)} AS cause_text FROM al WHERE seq = n_rows - 1")
    q["csv_export"] = q["data_table"]
    q["measured_risk_series"] = f"{WITH_RISK} SELECT {ids}, {single('risk_raw', 'risk_raw')}, {single('risk', 'risk')} FROM risk".replace(READINGS, MEASURED)
    q["measured_ewma"] = f"{WITH_R}, {ewma_cte()} SELECT {ids}, {', '.join(single(c, c) for c in EWMA)} FROM ew".replace(READINGS, MEASURED)
    q["measured_ewma_impute"] = (f"{WITH_R}, {ewma_cte(spans=(6,))} SELECT {ids}, " + ", ".join(single(f"coalesce(r.{s}, ew.{s}_ewma_6)", s) for s in SENSORS)
                                 + " FROM r JOIN ew USING (site, seq)").replace(READINGS, MEASURED)
    for name in ("alert_states", "rolling_stats", "lags", "diffs", "stuck_sensors", "sensor_profile", "missing_flags", "limit_breaches"):
        q[f"measured_{name}"] = q[name].replace(READINGS, MEASURED)
    q["lead_time_quantiles"] = (f"{WITH_EV}, x AS (SELECT event_type, count(*) AS n_events, list_sort(list(lead_us)) AS xs FROM lt WHERE lead_us IS NOT NULL GROUP BY event_type) "
                                "SELECT event_type, n_events, " + ", ".join(f"CAST(xs[CAST(ceil({p / 100} * n_events) AS BIGINT)] AS BIGINT) AS lead_us_p{p}" for p in (50, 90, 99)) + " FROM x")
    q["sql_site_comparison"], q["sql_site_comparison_24h"] = q["site_comparison"], q["site_comparison_24h"]
    q["sql_risk_levels"] = q["risk_levels"]
    q["sql_risk_raw"] = q["risk_raw"]
    q["sql_alerts_of_site"] = q["alert_states"] + " WHERE site = 'S1'"
    q["sql_breaches"] = f"{WITH_R} SELECT {ids}, 'turbidity' AS sensor, {r6('turbidity', 'value')} FROM r WHERE turbidity < 0 OR turbidity > 4"
    q["sql_diagnoses"] = (f"{WITH_R}, {rule_cte()} SELECT {ids}, {primary(HITS)} AS primary_cause, {confidence(HITS)} AS confidence, {lookup(primary(HITS), CAUSE_TEXT)} AS cause_text, "
                          + "CASE " + primary(HITS) + " " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CAUSES)) + " END AS cause_index FROM fe")
    q["stream_late_rows"] = q["alert_states"].replace(READINGS, f"{ALIVE}, {MEASURED.replace('FROM events', 'FROM alive')}")
    return q
