"""What a site's released readings become, given what is known of the site: numpy on whole runs of readings.

A fold takes the state of a site, its next readings in order, the readings just before them
and those that have arrived after them, and gives the new state and a row per reading. ``sight``
tells how many of those after them it looks at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd

from ..config import DIFFS, LAGS, RISK_SPAN, SENSORS, SPANS, STUCK_EPS, STUCK_WINDOW, WINDOWS, AlertParams
from ..operators.alerts import LEVELS
from ..operators.ewma import decay


def decayed_sums(x: np.ndarray, span: float, num: np.ndarray, den: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decayed sums of values and weights after every row of ``x`` (rows x columns, NaN where a value is
    missing), going on from ``num`` and ``den``. Weights grow inside blocks that cannot overflow."""
    q = decay(span)
    size = max(1, min(512, int(300 / -log(q))))
    there = ~np.isnan(x)
    parts = {"n": np.where(there, x, 0.0), "d": there.astype(float)}
    out = {k: np.empty(x.shape) for k in parts}
    ends = {"n": np.asarray(num, float), "d": np.asarray(den, float)}
    for at in range(0, len(x), size):
        k = np.arange(1, min(size, len(x) - at) + 1)[:, None]
        for name, v in parts.items():
            out[name][at:at + size] = q ** k * (ends[name] + np.cumsum(v[at:at + size] * q ** -k, axis=0))
            ends[name] = out[name][at + len(k) - 1]
    return out["n"], out["d"]


def runs(above: np.ndarray, before: int) -> np.ndarray:
    """Length of the run of true values that ends at each row; ``before`` of them precede the first."""
    at = np.arange(len(above))
    broken = np.maximum.accumulate(np.where(above, -1 - before, at)) if len(above) else at
    return at - broken


def alert_levels(risk: np.ndarray, p: AlertParams, level: int = 0, over_warn: int = 0, over_crit: int = 0) -> tuple[np.ndarray, int, int]:
    """Levels of all rows and both counters at the end. From each level the next row that leaves it is
    looked up, so the work is one step per change of level."""
    n = len(risk)
    # either threshold counts towards a warning
    warm_run, hot_run = runs(risk >= min(p.warn, p.crit), over_warn), runs(risk >= p.crit, over_crit)
    warm, hot = warm_run >= p.persistence, hot_run >= p.persistence
    calm, cooled = risk < p.warn - p.hysteresis, risk < p.crit - p.hysteresis
    leaves = [np.flatnonzero(warm | hot), np.flatnonzero(hot | calm), np.flatnonzero(cooled)]
    levels, at = np.empty(n, np.int8), 0
    while at < n:
        k = np.searchsorted(leaves[level], at)
        stop = int(leaves[level][k]) if k < len(leaves[level]) else n
        levels[at:stop] = level
        if stop < n:
            level = (1 if risk[stop] >= p.warn else 0) if level == 2 else 2 if hot[stop] else 1 if level == 0 else 0
            levels[stop] = level
        at = stop + 1
    return levels, int(warm_run[-1]) if n else over_warn, int(hot_run[-1]) if n else over_crit


@dataclass(frozen=True)
class AlertFold:
    """Smoothed risk and alert level from ``risk_raw``."""

    params: AlertParams = AlertParams()
    span: int = RISK_SPAN

    state = "n long, num double, den double, over_warn long, over_crit long, level int"
    start = (0, 0.0, 0.0, 0, 0, 0)
    tail = 0
    made = "seq long, risk double, alert_level string, alert_changed boolean"

    def sight(self, rows: pd.DataFrame) -> Callable[[int], int]:
        return lambda end: end

    def __call__(self, state: tuple, rows: pd.DataFrame, tail: np.ndarray, ahead: pd.DataFrame) -> tuple[tuple, dict]:
        n, num, den, over_warn, over_crit, level = state
        nums, dens = decayed_sums(rows[["risk_raw"]].to_numpy(float), self.span, np.array([num]), np.array([den]))
        risk = np.clip(nums[:, 0] / dens[:, 0], 0.0, 100.0)
        levels, over_warn, over_crit = alert_levels(risk, self.params, level, over_warn, over_crit)
        before = np.concatenate([[level], levels[:-1]])
        out = {"seq": n + np.arange(len(rows)), "risk": risk, "alert_level": np.array(LEVELS, object)[levels], "alert_changed": levels != before}
        return (n + len(rows), float(nums[-1, 0]), float(dens[-1, 0]), over_warn, over_crit, int(levels[-1])), out


def window_parts(x: np.ndarray, windows: tuple[int, ...]) -> dict[int, tuple]:
    """Count, mean, squared deviations, minimum and maximum of each window's rows. A window that is a
    multiple of an earlier one is put together from it, as in the batch operator."""
    out: dict[int, tuple] = {}
    for w in sorted(windows):
        prev = max((v for v in out if w % v == 0), default=None)
        if prev is None:
            padded = np.vstack([np.full((w - 1, x.shape[1]), np.nan), x])
            pieces = [(~np.isnan(v), np.where(np.isnan(v), 0.0, v), 0.0, v, v) for k in range(w) for v in [padded[k:k + len(x)]]]
        else:
            def back(a: np.ndarray, k: int, fill: float) -> np.ndarray:
                return np.vstack([np.full((min(k, len(a)), a.shape[1]), fill), a[:max(len(a) - k, 0)]])

            fills = (0, 0.0, 0.0, np.nan, np.nan)
            pieces = [tuple(back(a, prev * k, f) for a, f in zip(out[prev], fills)) for k in range(w // prev)]
        n = sum(p[0].astype(float) for p in pieces)
        with np.errstate(invalid="ignore", divide="ignore"):
            m = sum(p[0] * p[1] for p in pieces) / n
            q = sum(p[2] + p[0] * np.where(p[0] > 0, p[1] - m, 0.0) ** 2 for p in pieces)
        lo, hi = pieces[0][3], pieces[0][4]
        for p in pieces[1:]:
            lo, hi = np.fmin(lo, p[3]), np.fmax(hi, p[4])
        out[w] = (n, np.where(n > 0, m, 0.0), q, lo, hi)
    return out


@dataclass(frozen=True)
class FeatureFold:
    """All window features, as :func:`weir.operators.features.all_features` gives them. ``tail`` readings
    stay as context; exponential means go on from their decayed sums."""

    sensors: tuple[str, ...] = SENSORS
    windows: tuple[int, ...] = WINDOWS
    spans: tuple[int, ...] = SPANS
    diffs: tuple[int, ...] = DIFFS
    lags: tuple[int, ...] = LAGS
    stuck: int = STUCK_WINDOW
    eps: float = STUCK_EPS

    state = "n long, num array<double>, den array<double>, held array<double>"

    @property
    def start(self) -> tuple:
        none = [0.0] * (len(self.sensors) * len(self.spans))
        return 0, none, none, [float("nan")] * len(none)

    @property
    def tail(self) -> int:
        return max((*self.windows, self.stuck, *(k + 1 for k in (*self.lags, *self.diffs)))) - 1

    @property
    def made(self) -> str:
        names = [f"{s}_w{w}_{x} double" for s in self.sensors for w in self.windows for x in ("mean", "std", "min", "max", "range")]
        names += [f"{s}_ewma_{k} double" for s in self.sensors for k in self.spans]
        names += [f"{s}_diff{k} double" for s in self.sensors for k in self.diffs] + [f"{s}_lag{k} double" for s in self.sensors for k in self.lags]
        return ", ".join(["seq long", *names, *(f"{s}_stuck int" for s in self.sensors)])

    def sight(self, rows: pd.DataFrame) -> Callable[[int], int]:
        """For a run that ends before row ``end``, the end of the rows its lags look at: the back-fill takes every
        sensor's next value, and a lag is null unless as many rows follow that value."""
        some = [np.flatnonzero(rows[s].notna().to_numpy()) for s in self.sensors]
        far = max(self.lags, default=0) + 1

        def until(end: int) -> int:
            nexts = [int(at[k]) if k < len(at) else len(rows) for at in some for k in [np.searchsorted(at, end)]]
            return min(len(rows), max(nexts, default=end) + far)

        return until

    def __call__(self, state: tuple, rows: pd.DataFrame, tail: np.ndarray, ahead: pd.DataFrame) -> tuple[tuple, dict]:
        names, m, t = list(self.sensors), len(rows), len(tail)
        fresh = rows[names].to_numpy(float)
        x = np.vstack([tail, fresh])
        out: dict = {"seq": state[0] + np.arange(m)}
        parts = window_parts(x, tuple(sorted({*self.windows, self.stuck})))

        def deviation(w: int) -> np.ndarray:
            n, _, q, _, _ = (a[t:] for a in parts[w])
            return np.where(n > 1, np.sqrt(q / np.maximum(n - 1, 1)), 0.0)

        for w in self.windows:
            n, mean, _, lo, hi = (a[t:] for a in parts[w])
            of = {"mean": np.where(n > 0, mean, np.nan), "std": deviation(w), "min": lo, "max": hi, "range": hi - lo}
            out |= {f"{s}_w{w}_{k}": v[:, i] for i, s in enumerate(names) for k, v in of.items()}
        nums, dens, helds = [], [], []
        for j, span in enumerate(self.spans):
            own = slice(j * len(names), (j + 1) * len(names))
            num, den = decayed_sums(fresh, span, *(np.array(state[k][own]) for k in (1, 2)))
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = pd.DataFrame(np.vstack([np.array(state[3][own]), np.where(np.isnan(fresh), np.nan, num / den)])).ffill().to_numpy()[1:]
            out |= {f"{s}_ewma_{span}": mean[:, i] for i, s in enumerate(names)}
            nums, dens, helds = nums + num[-1].tolist(), dens + den[-1].tolist(), helds + mean[-1].tolist()
        here = np.arange(t, t + m)
        for k in self.diffs:
            gap = np.where((here >= k)[:, None], fresh - x[np.maximum(here - k, 0)], 0.0)
            out |= {f"{s}_diff{k}": np.where(np.isnan(v), 0.0, v) for s, v in zip(names, gap.T)}
        long = np.vstack([x, ahead[names].to_numpy(float)])  # also what has arrived after these readings
        for i, s in enumerate(names):
            some = np.flatnonzero(~np.isnan(long[:, i]))
            for k in self.lags:
                nth = np.searchsorted(some, np.maximum(here - k, 0))  # the next value there is
                at = np.append(some, len(long))[nth]
                out[f"{s}_lag{k}"] = np.where(at + k < len(long), np.append(long[:, i], np.nan)[at], np.nan)
        still = deviation(self.stuck) < self.eps
        out |= {f"{s}_stuck": still[:, i].astype(np.int32) for i, s in enumerate(names)}
        return (state[0] + m, nums, dens, helds), out
