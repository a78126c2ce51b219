"""Exponentially weighted mean (bias-corrected weights, nulls age the weights and
repeat the last value) without a sequential pass over a site.

At a row that has a value the newest weight is 1, so terms older than
:func:`reach` rows fall below double precision and a halo of that length gives the
exact result. Rows without a value repeat the last result: inside the chunk by a
running ``last``, and for a null run that began in an earlier chunk by the value
carried from the series index (:mod:`weir.operators.index`).

Sums run inside sub-blocks, where growing weights cannot overflow; a row then adds
the aged end state of the sub-block before its own. States travel as one struct, so
the windows below copy it as bytes instead of field by field.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import DataFrame

from ..config import LAYOUT, Layout
from .chunks import CHUNK, div

SUB = "_sub"
ORDER = f"{SUB}, seq"


def decay(span: float) -> float:
    if span <= 1:
        raise ValueError("span must be greater than 1")
    return 1 - 2 / (span + 1)


def reach(span: float) -> int:
    """Rows after which a weight no longer shows in a double: q^r < 1e-18."""
    return ceil(41.5 / -log(decay(span)))


def hops(spans, layout: Layout = LAYOUT) -> int:
    """Sub-blocks to look back on."""
    return max((ceil(reach(s) / layout.ewma_block) for s in spans), default=0)


def halo_rows(spans, extra: int = 0, layout: Layout = LAYOUT) -> int:
    """Halo in whole sub-blocks; its last ``extra`` rows get an exact mean as well."""
    return (hops(spans, layout) + ceil(extra / layout.ewma_block)) * layout.ewma_block


def _fields(pairs):
    return [(c, s, f"{c}_{s}_{part}") for c, s in pairs for part in "nd"]


def _age(span, layout: Layout, offset: int) -> str:
    return f"exp((seq % {layout.ewma_block} + {offset}) * {log(decay(span))!r}D)"


def block_sums(df: DataFrame, pairs, key: str = "site", layout: Layout = LAYOUT) -> DataFrame:
    """Add ``_dec``: decayed sums of value and weight since the row's sub-block began."""
    weights = [f"exp((seq % {layout.ewma_block}) * {-log(decay(s))!r}D) AS _g{s}" for s in sorted({s for _, s in pairs})]
    df = df.withColumn(SUB, div("seq", layout.ewma_block))
    over = (f"OVER (PARTITION BY {key}, {CHUNK}, {SUB} ORDER BY seq "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    base = list(df.columns)
    df = df.selectExpr("*", *weights)
    sums = []
    for c, s, name in _fields(pairs):
        term = f"{c} * _g{s}" if name.endswith("n") else f"CASE WHEN {c} IS NOT NULL THEN _g{s} END"
        sums.append(f"sum({term}) {over} AS _r_{name}")
    df = df.selectExpr("*", *sums)
    dec = ", ".join(f"'{name}', coalesce(_r_{name}, 0D) / _g{s}" for c, s, name in _fields(pairs))
    df = df.selectExpr(*base, f"named_struct({dec}) AS _dec")
    for _ in range(hops([s for _, s in pairs], layout) - 1):
        df = df.selectExpr("*", previous_block("_dec" if "_full" not in df.columns else "_full", key, layout))
        df = df.selectExpr(*base, "_dec", f"named_struct({_joined(pairs, layout)}) AS _full")
    return df if "_full" in df.columns else df.selectExpr("*", "_dec AS _full")


def _joined(pairs, layout: Layout) -> str:
    return ", ".join(f"'{name}', _dec.{name} + {_age(s, layout, 1)} * coalesce(_prev.{name}, 0D)"
                     for c, s, name in _fields(pairs))


def previous_block(state: str = "_full", key: str = "site", layout: Layout = LAYOUT) -> str:
    """Window expression ``_prev``: state at the end of the sub-block before."""
    b = layout.ewma_block
    return (f"last(CASE WHEN seq % {b} = {b - 1} THEN {state} END, true) OVER (PARTITION BY {key}, {CHUNK} "
            f"ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _prev")


def mean_expr(col: str, span, layout: Layout = LAYOUT) -> str:
    """The mean at a row that has a value (null elsewhere), from ``_dec`` and ``_prev``."""
    part = {p: f"_dec.{col}_{span}_{p} + {_age(span, layout, 1)} * coalesce(_prev.{col}_{span}_{p}, 0D)" for p in "nd"}
    return f"CASE WHEN {col} IS NOT NULL THEN try_divide({part['n']}, {part['d']}) END"


HELPERS = (SUB, "_dec", "_full", "_prev")
