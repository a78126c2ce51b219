"""Alert levels with persistence and hysteresis, without a sequential pass.

Each row is a map on the three states (what it makes of normal, warning, critical).
Maps compose, so a chunk is a map too: chunks are folded independently, their maps
are folded in two small levels to get the state each chunk starts in, and a row's
state is its running map applied to that.

With warn <= crit and a hysteresis of at least 0 every map is either constant or leaves
*warning* alone, which makes the running composition expressible with running max/last
windows. For any other parameters the 27 maps are numbers, two of them compose by a table of
27 x 27, and a chunk is scanned by doubling: after the k-th step a row holds the composition
of its last 2^k rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import LAYOUT, RISK_SPAN, AlertParams, Layout
from ..storage import written
from .chunks import CHUNK, carry, div, own_rows
from .ewma import SUB
from .risk import chunked_risk

LEVELS = ("normal", "warning", "critical")  # states 0, 1, 2
_IMG = ("_n", "_w", "_c")


def _row_images(risk: str, p: AlertParams, window) -> dict[str, Column]:
    x = F.col(risk)
    last_p = window.rowsBetween(-(p.persistence - 1), 0)
    # a reading over either threshold counts towards a warning
    warm = F.count(F.when(x >= min(p.warn, p.crit), 1)).over(last_p) == p.persistence
    hot = F.count(F.when(x >= p.crit, 1)).over(last_p) == p.persistence
    return {
        "_n": F.when(hot, 2).when(warm, 1).otherwise(0),
        "_w": F.when(hot, 2).when(x < p.warn - p.hysteresis, 0).otherwise(1),
        "_c": F.when((x < p.crit - p.hysteresis) & (x >= p.warn), 1)
               .when(x < p.crit - p.hysteresis, 0).otherwise(2),
    }


def _running_images(df: DataFrame, part: list[str], order: list[str], at: str) -> DataFrame:
    """Replace each row's images by those of all rows of its partition up to and with it."""
    w = W.partitionBy(*part).orderBy(*order)
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    pos, n, c = F.col(at), F.col("_n"), F.col("_c")
    const = (n == F.col("_w")) & (n == c)
    leaves = ~const & (c != 2)  # takes critical elsewhere
    df = df.select(
        "*",
        F.last(F.when(const, F.struct(pos.alias("at"), n.alias("to"))), ignorenulls=True).over(upto).alias("_base"),
        F.max(F.when(~const & (n == 1), pos)).over(upto).alias("_up"),
        F.max(F.when(leaves, pos)).over(before).alias("_left"),
    )
    since = F.coalesce(F.col("_base.at"), F.lit(-1))
    first_leave = leaves & (F.coalesce(F.col("_left"), F.lit(-1)) <= since)
    df = df.withColumn(
        "_out", F.last(F.when(first_leave, F.struct(pos.alias("at"), c.alias("to"))), ignorenulls=True).over(upto))
    up = F.coalesce(F.col("_up"), F.lit(-1))
    out_at = F.coalesce(F.col("_out.at"), F.lit(-1))
    from_n = F.when(up > since, 1).otherwise(0)
    from_c = (F.when(out_at <= since, 2).when(F.col("_out.to") == 1, 1)
              .when(up > out_at, 1).otherwise(0))
    base = F.col("_base.to")
    settled = F.when(base == 1, 1).when(base == 0, from_n).when(base == 2, from_c)
    keep = [x for x in df.columns if x not in ("_base", "_up", "_left", "_out", *_IMG)]
    return df.select(*keep, F.coalesce(settled, from_n).alias("_n"), F.coalesce(settled, F.lit(1)).alias("_w"),
                     F.coalesce(settled, from_c).alias("_c"))


def _code(n, w, c):
    return 9 * n + 3 * w + c


def compositions() -> list[int]:
    """The code of "first a, then b" at 27 * a + b."""
    images = [(k // 9, k // 3 % 3, k % 3) for k in range(27)]
    return [_code(*(b[state] for state in a)) for a in images for b in images]


def _scanned_images(df: DataFrame, part: list[str], order: list[str], rows: int) -> DataFrame:
    """As :func:`_running_images`, for maps of any kind; a partition has at most ``rows`` rows."""
    w = W.partitionBy(*part).orderBy(*order)
    table = F.lit(compositions()).cast("array<int>")
    out = df.withColumn("_map", _code(*(F.col(x).cast("int") for x in _IMG))).drop(*_IMG)
    step = 1
    while step < rows:
        out = out.withColumn("_before", F.lag("_map", step).over(w))
        out = out.withColumn("_map", F.coalesce(F.get(table, 27 * F.col("_before") + F.col("_map")), F.col("_map"))).drop("_before")
        step *= 2
    m = F.col("_map")
    images = {"_n": F.floor(m / 9), "_w": F.floor(m / 3) % 3, "_c": m % 3}
    return out.withColumns({k: c.cast("int") for k, c in images.items()}).drop("_map")


def _images_upto(df: DataFrame, part: list[str], order: list[str], at: str, p: AlertParams, rows: int) -> DataFrame:
    if p.warn <= p.crit and p.hysteresis >= 0:
        return _running_images(df, part, order, at)
    return _scanned_images(df, part, order, rows)


def _apply(state, images=_IMG) -> Column:
    n, w, c = (F.col(x) for x in images)
    return F.when(state == 0, n).when(state == 1, w).otherwise(c)


def _entry_states(chunks: DataFrame, key: str, fan: int, p: AlertParams) -> DataFrame:
    """(key, _chunk, _enter): the state each chunk starts in. ``chunks`` has a row per chunk."""
    inside = _images_upto(chunks.withColumn("_grp", div(CHUNK, fan)), [key, "_grp"], [CHUNK], CHUNK, p, fan)
    inside = written(inside, "alert-chunks")
    groups = inside.groupBy(key, "_grp").agg(*[F.max_by(x, CHUNK).alias(x) for x in _IMG])
    longest = (inside.agg(F.max("_grp")).first()[0] or 0) + 1  # one number
    over_groups = W.partitionBy(key).orderBy("_grp")
    groups = _images_upto(groups, [key], ["_grp"], "_grp", p, longest).select(
        key, "_grp", F.lag("_n", 1, 0).over(over_groups).alias("_genter"))
    before = W.partitionBy(key, "_grp").orderBy(CHUNK)
    inside = inside.select(key, "_grp", CHUNK, *[F.lag(x).over(before).alias(x) for x in _IMG])
    return inside.join(groups, [key, "_grp"]).select(
        key, CHUNK, F.coalesce(_apply(F.col("_genter")), F.col("_genter")).alias("_enter"))


def _level(state) -> Column:
    return F.when(state == 0, LEVELS[0]).when(state == 1, LEVELS[1]).otherwise(LEVELS[2])


def fold_alerts(cut: DataFrame, params: AlertParams, key: str = "site", order: tuple = (SUB, "seq"),
                layout: Layout = LAYOUT) -> DataFrame:
    """Alert columns for rows that are cut into chunks (halo included) and carry ``risk``.

    Rows are folded within their chunk and written once; from one row per chunk follows the state each
    chunk starts in, and the written rows take it up."""
    w = W.partitionBy(key, CHUNK).orderBy(*order)
    drop = [c for c in (SUB,) if c in cut.columns]
    named = {**_row_images("risk", params, w)}
    if "ts" in cut.columns:
        named["prev_ts"] = F.lag("ts").over(w)
    if "event_type" in cut.columns:
        named["_pe"] = F.lag("event_type").over(w)
        named["_first"] = F.lag("seq").over(w).isNull()
    own = own_rows(cut.select("*", *[c.alias(k) for k, c in named.items()]), layout)
    run = _images_upto(own, [key, CHUNK], list(order), "seq", params, layout.chunk)
    more = [F.lag(x).over(w).alias("_p" + x) for x in _IMG]
    has_events = "_pe" in run.columns
    if has_events:
        starts = F.when(F.col("_first") | ~F.col("event_type").eqNullSafe(F.col("_pe")), F.col("seq"))
        more.append(F.max(starts).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("_ev"))
    run = run.select("*", *more).drop("_pe", "_first", *drop)
    rows = written(run.withColumns({c: F.col(c).cast("tinyint") for c in (*_IMG, *("_p" + x for x in _IMG))}), "alert-rows")
    chunks = rows.groupBy(key, CHUNK).agg(*[F.max_by(x, "seq").alias(x) for x in _IMG])
    entry = _entry_states(chunks, key, layout.fan, params)
    if has_events:
        begun = carry(written(rows.groupBy(key, CHUNK).agg(F.max("_ev").alias("_ev")), "event-starts"), CHUNK, ["_ev"], key, fan=layout.fan)
        entry = entry.join(begun.withColumnRenamed("_ev", "_ev_in"), [key, CHUNK])
    out = rows.join(entry, [key, CHUNK])
    now = _apply(F.col("_enter"))
    was = F.coalesce(_apply(F.col("_enter"), tuple("_p" + x for x in _IMG)), F.col("_enter"))
    out = out.withColumns({"alert_level": _level(now), "previous_level": _level(was), "alert_changed": now != was})
    if has_events:
        out = out.withColumn("event_start", F.coalesce("_ev", "_ev_in")).drop("_ev", "_ev_in")
    return out.drop(CHUNK, "_enter", *_IMG, *("_p" + x for x in _IMG))


def alert_states(df: DataFrame, params: AlertParams = AlertParams(), span: int = RISK_SPAN,
                 keep: list[str] | None = None, layout: Layout = LAYOUT) -> DataFrame:
    """Add ``risk_raw, risk, alert_level, previous_level, alert_changed`` to numbered readings,
    and ``prev_ts`` / ``event_start`` (seq at which the row's run of one event_type began).
    ``keep`` names the input columns to carry along (all by default). The first reading of a series
    is the first one the frame holds, at whatever position. The folded readings
    are written once; write the result too if several steps use it."""
    cut = chunked_risk(df, span, extra=params.persistence, layout=layout)
    if keep is not None:
        cut = cut.select("site", "seq", CHUNK, SUB, *[c for c in keep if c not in ("site", "seq")], "risk_raw", "risk")
    return fold_alerts(cut, params, layout=layout)


def alert_states_of(risk: DataFrame, params: AlertParams = AlertParams(), layout: Layout = LAYOUT) -> DataFrame:
    """The same on a table that already has (site, seq, risk)."""
    from .chunks import with_chunks

    return fold_alerts(with_chunks(risk, params.persistence, layout), params, order=("seq",), layout=layout)
