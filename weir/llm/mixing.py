"""Mixing to target weights with soft membership.

A classifier fitted on a labelled table gives every document posteriors over the domains,
so a document belongs to several domains in part. Document rates r >= 0 are then fitted by
projected-gradient least squares: with n_i tokens and posteriors p_i, the expected tokens
of domain d are T_d = sum_i r_i n_i p_id, and the rates minimise the distance of T to the
targets, starting from 1. In the metric given by G = sum_i n_i p_i p_i' (domains x domains)
a step is

    r_i <- max(0, r_i - p_i . G^-1 (T - target))

which needs one distributed sum of the size of the domains per iteration; part of the last change
is kept up from step to step, which speeds up what bounds slow down. Rates above 1
stand for repetition, rates below 1 for sampling.

The classifier is a multinomial logistic regression over the presence of informative words and
of bands of length and of the shares of symbols and capitals; words and weights come from a bounded
sample of labelled documents, whose features (small numbers, no texts) are fitted on the driver.
Fitted weights share out what words have in common, so that posteriors agree with the domains'
shares. The distance from the targets that the fit ends with is reported with every rate.

Null and empty texts have no tokens: they weigh nothing, and their rate follows from their
posteriors. Null ids in the labelled table are ignored, several labels of one document count once
each, rows that repeat a doc_id count once in the sample (by their smallest text) and get a rate
each; a null doc_id in the documents is kept. Without labels all posteriors are equal. Without
tokens all rates are 1. Extra columns are ignored. A long text is one row.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..storage import written
from .common import bound, packed, whole_text
from .quality_rules import SPACE

#: Expected shares of the tokens.
TARGETS = {"clean": 0.8, "low": 0.05, "toxic": 0.15}
#: Labelled documents and words of the classifier.
SAMPLE = 8_000
WORDS = 64
LEAST_DOCS = 5
#: Weight of the penalty on the classifier's weights.
PENALTY = 2.0
#: Most moves; the fit ends at the targets, or where this many moves bring less than a thousandth.
ITERATIONS, PATIENCE = 400, 12
#: Distance from the targets, as a share of all tokens, at which the fit ends.
TOLERANCE = 1e-7


def domains_of(labels: DataFrame) -> DataFrame:
    """doc_id, domain: low quality, else toxic, else clean; rows that say neither are left out."""
    domain = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(
        (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), "clean")
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")).filter("doc_id IS NOT NULL AND domain IS NOT NULL")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPACE, -1), lambda w: w != "")


def bands(text: Column) -> Column:
    """Tokens for length and for the shares of symbols and capitals, in bands of doubling size; they hold a
    space, as no word does."""
    def band(name: str, pattern: str) -> Column:
        share = (F.size(F.split(text, pattern, -1)) - 1) / F.greatest(F.length(text), F.lit(1))
        return F.concat(F.lit(f"{name} "), F.least(F.lit(8), F.floor(F.log2(1 + 256 * share))).cast("string"))

    length = F.concat(F.lit("length "), F.floor(F.log2(1.0 + F.length(text))).cast("string"))
    return F.array(length, band("symbols", r"[#*$%&|<>!]"), band("capitals", "[A-Z]"))


def softmax_rows(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def logistic(x: np.ndarray, y: np.ndarray, classes: int, penalty: float = PENALTY, steps: int = 30) -> np.ndarray:
    """Weights (features x classes) of a multinomial logistic regression by Newton steps, halved until the
    penalised likelihood rises. The first feature is the intercept and goes free."""
    n, d = x.shape
    free = np.full(d, penalty)
    free[0] = 1e-6
    onehot, w = np.eye(classes)[y], np.zeros((d, classes))

    def loss(w: np.ndarray) -> float:
        z = x @ w
        top = z.max(1)
        return float((top + np.log(np.exp(z - top[:, None]).sum(1)) - z[np.arange(n), y]).sum() + 0.5 * (free[:, None] * w * w).sum())

    now = loss(w)
    for _ in range(steps):
        p = softmax_rows(x @ w)
        gradient = x.T @ (p - onehot) + free[:, None] * w
        curve = np.zeros((classes, d, classes, d))
        for i in range(classes):
            for j in range(i, classes):
                block = x.T @ (x * (p[:, i] * ((i == j) - p[:, j]))[:, None])
                curve[i, :, j] = curve[j, :, i] = block
            curve[i, :, i] += np.diag(free)
        move = np.linalg.solve(curve.reshape(classes * d, -1) + 1e-9 * np.eye(classes * d), gradient.T.ravel()).reshape(classes, d).T
        size = 1.0
        while size > 1e-4 and loss(w - size * move) > now:
            size /= 2
        w, before = w - size * move, now
        now = loss(w)
        if before - now < 1e-7 * max(1.0, abs(now)):
            break
    return w


def train(docs: DataFrame, labelled: DataFrame, names: list[str], n: int = SAMPLE, vocabulary: int = WORDS) -> dict:
    """Prior and word weights per domain."""
    chosen = labelled.filter(F.col("domain").isin(names)).orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(n)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    some = some.groupBy("doc_id", "domain").agg(F.min("text").alias("text"))  # so that ``n`` bounds the rows
    seen = written(some.select("domain", F.array_union(F.array_distinct(words(F.col("text"))), bands(F.col("text"))).alias("words")), "labelled")
    size = {r["domain"]: r["count"] for r in seen.groupBy("domain").count().collect()}
    present = [d for d in names if size.get(d)]
    if not present:
        return {"prior": [0.0] * len(names), "weights": {}}
    counts = seen.select("domain", F.explode("words").alias("word")).groupBy("word").agg(
        *[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(names)])
    rate = [(F.col(f"n{i}") + 0.5) / (size.get(d, 0) + 1.0) for i, d in enumerate(names)]
    of = [i for i, d in enumerate(names) if d in present]
    mean_rate = sum((rate[i] for i in of), F.lit(0.0)) / len(of)
    spread = sum(((rate[i] - mean_rate) * (rate[i] - mean_rate) for i in of), F.lit(0.0)) / mean_rate
    some_rows = sum((F.col(f"n{i}") for i in range(len(names))), F.lit(0)) >= LEAST_DOCS
    is_band = F.instr("word", " ") > 0
    rows = counts.filter(some_rows | is_band).orderBy(F.desc(is_band), F.desc(F.round(spread, 12)), "word").limit(vocabulary).collect()
    features = [r["word"] for r in rows]
    # at most ``n`` rows with the numbers of the features they have
    spots = F.transform(F.array_intersect("words", F.from_json(F.lit(json.dumps(features)), "array<string>")),
                        lambda w: F.array_position(F.from_json(F.lit(json.dumps(features)), "array<string>"), w).cast("int"))
    seen_rows = seen.select("domain", F.array_sort(spots).alias("at")).orderBy("domain", "at").collect()
    x, y = np.zeros((len(seen_rows), len(features) + 1)), np.zeros(len(seen_rows), np.int64)
    x[:, 0] = 1.0
    for i, r in enumerate(seen_rows):
        x[i, r["at"]] = 1.0
        y[i] = present.index(r["domain"])
    w = logistic(x, y, len(present))
    # a domain without labels gets a posterior of none
    full = np.zeros((len(features) + 1, len(names)))
    full[0] = [0.0 if d in present else -30.0 for d in names]
    full[:, of] += w
    return {"prior": full[0].tolist(), "weights": dict(zip(features, full[1:].tolist()))}


def posteriors(text: Column, model: dict, n: int) -> Column:
    """struct(n_tokens, p): tokens of the text and its posteriors over ``n`` domains."""
    equal = F.array(*[F.lit(1.0 / n)] * n)
    vocabulary = sorted(model["weights"])

    def of(w: Column) -> Column:
        tokens = F.size(w).cast("long").alias("n_tokens")
        if not vocabulary:
            return F.struct(tokens, equal.alias("p"))
        known = F.from_json(F.lit(json.dumps(vocabulary)), "array<string>")
        table = F.from_json(F.lit(json.dumps(model["weights"])), "map<string,array<double>>")
        prior = F.array(*[F.lit(float(x)) for x in model["prior"]])
        hits = F.array_intersect(F.concat(w, bands(text)), known)
        logits = F.aggregate(hits, prior, lambda acc, x: F.zip_with(acc, F.element_at(table, x), lambda a, b: a + b))

        def softmax(z: Column) -> Column:
            e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
            return bound(e, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y)))

        return F.struct(tokens, bound(logits, softmax).alias("p"))

    return bound(words(text), of)


def _moved(state: Column, p: Column, moves: list[np.ndarray]) -> Column:
    """struct(r, y) after the given moves: the rate, and the point ahead of it at which the next gradient is
    taken. A move is the step of every domain and the share of the last change that is kept up."""
    known = F.from_json(F.lit(json.dumps([list(map(float, s)) for s in moves])), "array<array<double>>")

    def step(at: Column, s: Column) -> Column:
        down = F.aggregate(F.zip_with(p, F.slice(s, 1, F.size(p)), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
        r = F.greatest(F.lit(0.0), at["y"] - down)
        return F.struct(r.alias("r"), (r + F.element_at(s, -1) * (r - at["r"])).alias("y"))

    return F.aggregate(known, state, step)


def _rate(p: Column, moves: list[np.ndarray]) -> Column:
    """Rate after the given moves, as one expression of the posteriors ``p``."""
    return _moved(F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y")), p, moves)["r"]


def fit(members: DataFrame, targets: list[float], iterations: int = ITERATIONS) -> tuple[list[np.ndarray], float]:
    """Moves of the accelerated projected gradient, and how far the totals end from the targets, as a share of
    all tokens. ``members`` is a written table with n_tokens and p. The fit ends at the targets, or where
    ``PATIENCE`` moves no longer bring the totals nearer; every so many moves the rates are written, so that
    no pass repeats more than these."""
    size = len(targets)
    p = [F.get("p", F.lit(i)) for i in range(size)]
    sums = members.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), *[
        F.coalesce(F.sum(F.col("n_tokens") * p[i] * p[j]), F.lit(0.0)).alias(f"g{i}_{j}") for i in range(size) for j in range(size)]).first()
    total = float(sums["n"])
    if not total:
        return [], 0.0
    metric = np.linalg.pinv(np.array([[sums[f"g{i}_{j}"] for j in range(size)] for i in range(size)]), rcond=1e-9, hermitian=True)
    goal = np.array(targets) / sum(targets) * total
    rows = members.select("n_tokens", "p", F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y")).alias("state"))
    moves: list[np.ndarray] = []
    fresh, values, momentum = 0, [], 1.0
    while True:
        at = _moved(F.col("state"), F.col("p"), moves[len(moves) - fresh:])
        ahead = rows.select("n_tokens", "p", at.alias("state"))
        got = ahead.agg(*[F.sum(F.col(f"state.{v}") * F.col("n_tokens") * x).alias(f"{v}{i}") for v in "ry" for i, x in enumerate(p)]).first()
        off, off_ahead = (np.array([got[f"{v}{i}"] or 0.0 for i in range(size)]) - goal for v in "ry")
        distance = float(np.abs(off).max()) / total
        values.append(float(off @ metric @ off))
        idle = len(values) > PATIENCE and min(values[-PATIENCE:]) > 0.999 * min(values[:-PATIENCE])
        if distance <= TOLERANCE or idle or len(moves) >= iterations:
            return moves, distance
        if fresh == PATIENCE:
            rows, fresh = written(ahead, "rates"), 0
        following = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        moves.append(np.append(metric @ off_ahead, (momentum - 1) / following))
        momentum, fresh = following, fresh + 1


def fitted(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], n: int = SAMPLE) -> tuple[dict, DataFrame, list[np.ndarray], float]:
    """The classifier, a written table of doc_id and the posteriors ``m`` of every row, the steps
    that lead to the rates, and the distance from the targets."""
    names = sorted(targets)
    model = train(docs, labelled, names, n)
    members = written(docs.select("doc_id", posteriors(whole_text(), model, len(names)).alias("m")), "members")
    return model, members, *fit(members.select("m.n_tokens", "m.p"), [targets[d] for d in names])


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, n_tokens, the posterior of every domain, rate, and off_target: how far the expected totals are
    from the targets, as a share of all tokens (one value)."""
    return rates_of(docs, domains_of(labels), targets)


def rates_of(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """The same for domains as labelled in a table of doc_id, domain."""
    _, members, steps, distance = fitted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labelled, targets)
    return members.select("doc_id", "m.n_tokens", *[F.round(F.get("m.p", F.lit(i)), 9).alias(f"p_{d}") for i, d in enumerate(sorted(targets))],
                          F.round(_rate(F.col("m.p"), steps), 9).alias("rate"), F.lit(distance).alias("off_target"))


def drawn(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``docs`` mixed: every row as often as its rate says, the fraction drawn by a hash of its id
    and text, so that a repeated run draws the same. Posteriors are made twice, for the fit and for
    the draw, so that texts are neither written nor moved in between."""
    rows = packed(docs, "doc_id", "text")
    model, _, steps, _ = fitted(rows.drop("row"), domains_of(labels), targets)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    rate = bound(posteriors(whole_text(), model, len(targets)), lambda m: _rate(m.p, steps))
    times = F.floor(rate + draw).cast("int")
    # filtered by the copies, not by their number: a condition on that would work out the posteriors again
    copies = F.explode_outer(F.when(F.col("times") > 0, F.sequence(F.lit(1), F.col("times"))))
    return rows.select("row", times.alias("times")).withColumn("copy", copies).filter("copy IS NOT NULL").select("row.*")
