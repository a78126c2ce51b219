"""Feature frame over numbered readings.

All window features of a chunk come from one exchange: rows are hash-distributed by
(site, chunk) with a halo, sorted, and every window runs on that distribution.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..config import DIFFS, LAGS, LAYOUT, META, SENSORS, SPANS, STUCK_EPS, STUCK_WINDOW, WINDOWS, Layout
from ..functions.calendar import time_encodings
from .chunks import CHUNK, own_rows, with_chunks
from .ewma import HELPERS, ORDER, block_sums, halo_rows, mean_expr, previous_block
from .index import chunk_entries, series_facts, series_index, series_starts
from .rolling import base_exprs, join_exprs, pack_base, pack_joined, rolling_exprs, std_expr
from .sites import with_site_values

# ---- fixed values: name, numerator, denominator, offset ----
RATIOS = (
    ("chlor_turb_ratio", "chloramine", "turbidity", 0.01),
    ("cond_tds_ratio", "conductivity", "tds", 1.0),
    ("ph_hardness_ratio", "ph", "hardness", 1.0),
    ("oc_thm_ratio", "organic_carbon", "thm", 0.01),
)


def present(df: DataFrame, sensors=None) -> list[str]:
    return [s for s in (sensors or SENSORS) if s in df.columns]


def ratio_exprs(columns) -> list[str]:
    return [f"try_divide({a}, {b} + {off}D) AS {name}" for name, a, b, off in RATIOS if a in columns and b in columns]


def add_ratios(df: DataFrame) -> DataFrame:
    return df.selectExpr("*", *ratio_exprs(df.columns))


@dataclass
class Wanted:
    """Which families of window features to compute."""

    windows: tuple = ()
    spans: tuple = ()
    diffs: tuple = ()
    lags: tuple = ()
    stuck: int | None = None
    sensors: list = field(default_factory=list)


def window_features(df: DataFrame, want: Wanted, backfill: bool = True, eps: float = STUCK_EPS,
                    key: str = "site", layout: Layout = LAYOUT) -> DataFrame:
    """Add the families in ``want``; ``df`` is numbered readings. Input columns are kept.
    A slice may start at any position; positions must follow each other without gaps."""
    sensors, keep = want.sensors, list(df.columns)
    if not sensors:
        return df
    windows = tuple(sorted(set(want.windows) | ({want.stuck} if want.stuck else set())))
    back = tuple(sorted(set(want.lags) | set(want.diffs)))
    pairs = [(c, s) for c in sensors for s in want.spans]
    fill = bool(want.lags) and backfill
    gaps, moved = series_facts(df, sensors, key)
    if moved:  # the windows count from 0
        from_zero = with_site_values(df, series_starts(df, key), key).withColumn("seq", F.col("seq") - F.col("_first"))
        out = window_features(from_zero, want, backfill, eps, key, layout)
        return out.withColumn("seq", F.col("seq") + F.col("_first")).drop("_first")
    gaps = gaps if fill or pairs else []
    halo = max(0, *(w - 1 for w in windows or (1,)), *(back or (0,)))
    if pairs:
        halo = max(halo_rows(want.spans, layout=layout), -(-halo // layout.ewma_block) * layout.ewma_block)
    out = with_chunks(df, halo, layout, key)
    if fill and gaps:  # value at or after each row, within the chunk
        later = f"OVER (PARTITION BY {key}, {CHUNK} ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        out = out.selectExpr("*", *[
            e for c in gaps for e in (
                f"last({c}, true) {later} AS _nn_{c}",
                f"last(CASE WHEN {c} IS NOT NULL THEN seq END, true) {later} AS _ns_{c}")])
    if pairs:
        out = block_sums(out, pairs, key, layout)
    # the sub-block leads the order where there is one, so that all windows share one sort
    over = f"OVER (PARTITION BY {key}, {CHUNK} ORDER BY {ORDER if pairs else 'seq'}"
    steps = [previous_block("_full", key, layout)] if pairs else []
    if back:
        fields = [x for c in sensors for x in ((c, f"_nn_{c}", f"_ns_{c}") if fill and c in gaps else (c,))]
        out = out.selectExpr("*", f"struct({', '.join(fields)}) AS _now")
        steps += [f"lag(_now, {k}) {over}) AS _lag{k}" for k in back]
    if fill:
        steps += [f"first(_now) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _head",
                  f"max(seq) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS _top"]
    made: list[int] = []
    for w in windows:  # first the sliding frames, in the same pass as the lags
        if not any(w % v == 0 for v in made):
            steps += base_exprs(sensors, w, over)
            made.append(w)
    out = out.selectExpr("*", *steps) if steps else out
    for w in made:
        out = pack_base(out, sensors, w)
    held = []
    if pairs:
        means = ", ".join(f"'{c}_{s}', {mean_expr(c, s, layout)}" for c, s in pairs)
        out = out.selectExpr("*", f"named_struct({means}) AS _e").drop(*HELPERS[1:])
        own = f"seq >= {CHUNK} * {layout.chunk}"  # a halo row's mean may miss terms
        held = [f"last(CASE WHEN {own} THEN _e.{c}_{s} END, true) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _h_{c}_{s}"
                for c, s in pairs if c in gaps]
    for w in windows:  # then each longer window from the longest one that divides it
        if w not in made:
            prev = max(v for v in made if w % v == 0)
            out = out.selectExpr("*", *join_exprs(prev, w, over), *held)
            out, held = pack_joined(out, sensors, prev, w), []
            made.append(w)
    out = out.selectExpr("*", *held) if held else out
    out = own_rows(out, layout)
    if gaps:
        idx = series_index(df, gaps, want.spans, key, layout)
        out = out.join(chunk_entries(idx, gaps, want.spans, key, layout), [key, CHUNK])
    final = [f"`{c}`" for c in keep]
    if want.windows:
        final += rolling_exprs(sensors, want.windows)
    final += [(f"coalesce(_h_{c}_{s}, in_{c}_{s})" if c in gaps else f"_e.{c}_{s}") + f" AS {c}_ewma_{s}"
              for c, s in pairs]
    final += [f"coalesce({c} - _lag{k}.{c}, 0D) AS {c}_diff{k}" for c in sensors for k in want.diffs]
    for c in sensors:
        for k in want.lags:
            if fill and c in gaps:
                v = f"coalesce(CASE WHEN seq < {k} THEN _head._nn_{c} ELSE _lag{k}._nn_{c} END, nx_{c})"
                at = f"coalesce(CASE WHEN seq < {k} THEN _head._ns_{c} ELSE _lag{k}._ns_{c} END, nxs_{c})"
                final.append(f"CASE WHEN {at} + {k} < n_rows THEN {v} END AS {c}_lag{k}")
            elif fill:
                final.append(f"CASE WHEN seq >= {k} THEN _lag{k}.{c} WHEN {k} <= _top THEN _head.{c} END AS {c}_lag{k}")
            else:
                final.append(f"_lag{k}.{c} AS {c}_lag{k}")
    if want.stuck:
        final += [f"CASE WHEN {std_expr(c, want.stuck)} < {eps:.17g}D THEN 1 ELSE 0 END AS {c}_stuck" for c in sensors]
    return out.selectExpr(*final)


def add_rolling(df, sensors=None, windows=WINDOWS, layout: Layout = LAYOUT):
    return window_features(df, Wanted(sensors=present(df, sensors), windows=tuple(windows)), layout=layout)


def add_ewma(df, cols=None, spans=SPANS, layout: Layout = LAYOUT):
    return window_features(df, Wanted(sensors=present(df, cols), spans=tuple(spans)), layout=layout)


def add_diffs(df, sensors=None, ks=DIFFS, layout: Layout = LAYOUT):
    return window_features(df, Wanted(sensors=present(df, sensors), diffs=tuple(ks)), layout=layout)


def add_lags(df, sensors=None, lags=LAGS, backfill: bool = True, layout: Layout = LAYOUT):
    return window_features(df, Wanted(sensors=present(df, sensors), lags=tuple(lags)), backfill, layout=layout)


def add_stuck_flags(df, sensors=None, window: int = STUCK_WINDOW, eps: float = STUCK_EPS, layout: Layout = LAYOUT):
    return window_features(df, Wanted(sensors=present(df, sensors), stuck=window), eps=eps, layout=layout)


def all_features(df: DataFrame, sensors=None, layout: Layout = LAYOUT) -> DataFrame:
    """Every feature family, before rows with nulls are dropped."""
    return _with_fixed(df, Wanted(sensors=present(df, sensors), windows=WINDOWS, spans=SPANS, diffs=DIFFS, lags=LAGS,
                                  stuck=STUCK_WINDOW), layout)


def _with_fixed(df: DataFrame, want: Wanted, layout: Layout) -> DataFrame:
    """The window features in ``want`` and those of single rows."""
    out = window_features(df, want, layout=layout)
    clock = time_encodings("ts") if "ts" in df.columns else {}
    return out.select("*", *[c.alias(n) for n, c in clock.items()], *[F.expr(e) for e in ratio_exprs(df.columns)])


#: Columns that splits and targets add; never features.
ADDED = ("role", "fold", "pos", "target", "frame_rows")


def feature_columns(df: DataFrame) -> list[str]:
    return sorted(c for c in set(df.columns) - set(META) - set(ADDED) if not c.startswith("target_"))


def build_features(df: DataFrame, sensors=None, layout: Layout = LAYOUT) -> DataFrame:
    """All features; rows with any null feature or null target are dropped last, so they
    still count as positions in every window."""
    return _whole(all_features(df, sensors, layout))


#: Values below this keep every sum and square of a window finite.
ORDINARY = 1e100


def kept_rows(df: DataFrame, sensors=None, layout: Layout = LAYOUT) -> DataFrame:
    """The rows that :func:`build_features` keeps, without the features. A row whose own values are there, as they must
    be, has every mean, deviation, extreme, smoothed mean and difference, since each counts the row itself; its lags
    and the features of single rows may still be null, and are looked at. Where a value is NaN or beyond
    ``ORDINARY``, all features are."""
    have = present(df, sensors)
    odd = df.agg(*[F.max(~(F.abs(c) < ORDINARY)).alias(c) for c in have]).first() if have else ()
    if any(odd):
        return build_features(df, sensors, layout).select(*df.columns)
    return _whole(_with_fixed(df, Wanted(sensors=have, lags=LAGS), layout)).select(*df.columns)


def _whole(out: DataFrame) -> DataFrame:
    needed = feature_columns(out) + [c for c in ("potability",) if c in out.columns]
    return out.dropna(subset=needed)
