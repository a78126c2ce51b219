"""Labels and display text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import CAUSE_TEXT, CAUSES


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pretty(c, length: int | None = None) -> Column:
    """``pipe_corrosion`` -> ``Pipe Corrosion``, optionally cut to ``length``."""
    out = F.initcap(F.replace(_col(c), F.lit("_"), F.lit(" ")))
    return F.substring(out, 1, length) if length else out


def round_binary(c, digits: int) -> Column:
    """Round the exact binary value, ties to even. ``round`` and ``bround`` go by the shortest
    decimal text instead, where 0.605 (stored as 0.60499..) would become 0.61.

    The value is split in two halves whose products with the scale are exact, so the
    comparison with the midpoint is exact as well."""
    x, m = _col(c), float(10 ** digits)
    head = x.cast("float").cast("double")
    k = F.floor(x * m)
    over = (head * m - (k + 0.5)) + (x - head) * m
    up = (over > 0) | ((over == 0) & (k % 2 != 0))
    return (k + F.when(up, 1).otherwise(0)) / m


def value_with_unit(value, unit: str) -> Column:
    return F.format_string(f"%.2f {unit}", round_binary(value, 2))


def _lookup(c, pairs: dict, default) -> Column:
    flat = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*flat), _col(c)), default)


def cause_text(c) -> Column:
    """Sentence for a cause; an unknown cause is shown as it is."""
    return _lookup(c, CAUSE_TEXT, _col(c))


def cause_index(c) -> Column:
    """Class number in the fixed class order; unknown and null labels are class 0."""
    return _lookup(c, {name: i for i, name in enumerate(CAUSES)}, F.lit(0))
