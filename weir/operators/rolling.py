"""Trailing row windows: mean, standard deviation, minimum, maximum, range.

Only the smallest window is a sliding frame. A window whose length is a multiple of
the one before is put together from that one's (count, mean, squared deviations, min,
max) at a few fixed distances, one ``lag`` of a struct each. That keeps the work per
row constant where a 72-row frame re-reads 72 rows, and it is numerically stable: a
constant stretch has deviation 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import WINDOWS
_PARTS = ("n", "m", "q", "lo", "hi")


def _p(col: str, w: int, part: str) -> str:
    return f"_{col}_{w}_{part}"


def _struct(w: int) -> str:
    return f"_w{w}"


def base_exprs(sensors, w: int, over: str) -> list[str]:
    """Window expressions of a sliding frame; packed by :func:`pack_base`."""
    fr = f"{over} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return [f"{sql} {fr} AS {_p(c, w, part)}" for c in sensors
            for part, sql in (("n", f"count({c})"), ("m", f"avg({c})"), ("q", f"var_pop({c})"),
                              ("lo", f"min({c})"), ("hi", f"max({c})"))]


def pack_base(df: DataFrame, sensors, w: int) -> DataFrame:
    """Replace the columns of :func:`base_exprs` by one struct, copied as bytes from here on."""
    temp = {_p(c, w, x) for c in sensors for x in _PARTS}
    fields = ", ".join(
        f"'{c}_{x}', " + (f"{_p(c, w, 'q')} * {_p(c, w, 'n')}" if x == "q" else _p(c, w, x))
        for c in sensors for x in _PARTS)
    return df.selectExpr(*[f"`{x}`" for x in df.columns if x not in temp], f"named_struct({fields}) AS {_struct(w)}")


def join_exprs(prev: int, w: int, over: str) -> list[str]:
    return [f"lag({_struct(prev)}, {prev * i}) {over}) AS _p{i}" for i in range(1, w // prev)]


def pack_joined(df: DataFrame, sensors, prev: int, w: int) -> DataFrame:
    """Merge the window's pieces: counts, means, squared deviations about the joint mean."""
    pieces = [_struct(prev)] + [f"_p{i}" for i in range(1, w // prev)]
    n = {c: [f"coalesce({p}.{c}_n, 0)" for p in pieces] for c in sensors}
    m = {c: [f"coalesce({p}.{c}_m, 0D)" for p in pieces] for c in sensors}
    df = df.selectExpr("*", *[f"{' + '.join(n[c])} AS _n_{c}" for c in sensors], *[
        f"try_divide({' + '.join(f'{a} * {b}' for a, b in zip(n[c], m[c]))}, {' + '.join(n[c])}) AS _m_{c}"
        for c in sensors])
    fields = []
    for c in sensors:
        q = [f"coalesce({p}.{c}_q, 0D)" for p in pieces]
        gap = [f"{a} * coalesce(({b} - _m_{c}) * ({b} - _m_{c}), 0D)" for a, b in zip(n[c], m[c])]
        fields += [f"'{c}_n', _n_{c}", f"'{c}_m', _m_{c}", f"'{c}_q', {' + '.join(q + gap)}",
                   f"'{c}_lo', least({', '.join(f'{p}.{c}_lo' for p in pieces)})",
                   f"'{c}_hi', greatest({', '.join(f'{p}.{c}_hi' for p in pieces)})"]
    temp = {*pieces[1:], *(f"_{x}_{c}" for c in sensors for x in "nm")}
    return df.selectExpr(*[f"`{x}`" for x in df.columns if x not in temp],
                         f"named_struct({', '.join(fields)}) AS {_struct(w)}")


def std_expr(c: str, w: int) -> str:
    n, q = f"{_struct(w)}.{c}_n", f"{_struct(w)}.{c}_q"
    return f"CASE WHEN {n} > 1 THEN sqrt({q} / ({n} - 1)) ELSE 0D END"


def rolling_exprs(sensors, windows=WINDOWS) -> list[str]:
    """SQL projections from the packed parts to the named statistics."""
    out = []
    for c in sensors:
        for w in windows:
            m, lo, hi = (f"{_struct(w)}.{c}_{x}" for x in ("m", "lo", "hi"))
            out += [f"{m} AS {c}_w{w}_mean", f"{std_expr(c, w)} AS {c}_w{w}_std",
                    f"{lo} AS {c}_w{w}_min", f"{hi} AS {c}_w{w}_max", f"{hi} - {lo} AS {c}_w{w}_range"]
    return out
