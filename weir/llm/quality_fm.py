"""Quality classifier: a factorisation machine.

Inputs are the hashed words of the whole text (with the square root of their share as
value), statistics of its structure, and its recorded length. The score is the sigmoid of

    w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)

whose second part is all pairwise interactions at rank F, in time linear in the inputs.

Null and empty texts have no words: their statistics are zero and they get a score from
these. A null or negative n_chars counts as zero. Repeated rows get equal scores; a null
doc_id is kept (and counts as held out). Without labelled rows the score is 0.5. Extra
columns of either table are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import in_batches
from .textfit import BUCKETS, SAMPLE, fit_in_one_task, sample, score_texts, token_ids

THRESHOLD = 0.7
RANK = 4
EPOCHS = 6
RATE = 0.05
MIN_DOCS = 3
L2_WORDS = 1e-4
#: Weight of the words as a whole beside the statistics.
WORDS_SHARE = 1.0

SYMBOLS = re.compile(r"[#*$%&|<>]")
MARKS = re.compile(r"[!?]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
DIGITS = re.compile(r"[0-9]")
N_STATS = 12


def statistics(text: str, n_chars: int | None) -> list[float]:
    """Structure statistics, each of order one."""
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n = len(words)
    per = 1.0 / max(1, n)
    chars = sum(map(len, words))
    share = 1.0 / max(1, chars)
    return [
        np.log1p(n) / 8,
        chars * per / 10,
        10 * len(SYMBOLS.findall(text)) * share,
        10 * len(MARKS.findall(text)) * share,
        len(UPPER.findall(text)) * share,
        5 * len(DIGITS.findall(text)) * share,
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(set(words)) * per,
        np.log1p(n / max(1, len(lines))) / 4,
        10 * text.count("|") * share,
        (text.count(".") + text.count(",")) * per,
        np.log1p(max(0, n_chars or 0)) / 10,
    ]


def words_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text's words; the squares of the values add up to one."""
    ids = token_ids(text)
    ids, n = np.unique(ids[ids >= 0], return_counts=True)
    return ids.astype(np.int32), np.sqrt(n / max(1, n.sum())).astype(np.float32) * WORDS_SHARE


class Machine:
    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def raw(self, ids: np.ndarray, x: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of ``n`` documents before the sigmoid, and the sums of v x per document."""
        vx = self.v[ids] * x[:, None]
        s = np.stack([np.bincount(doc, vx[:, f], n) for f in range(vx.shape[1])], axis=1)
        squares = np.bincount(doc, (vx ** 2).sum(axis=1), n)
        return self.w0 + np.bincount(doc, self.w[ids] * x, n) + 0.5 * ((s ** 2).sum(axis=1) - squares), s


def _inputs(rows: list[tuple[np.ndarray, np.ndarray, list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One list of (input, value, document); the statistics follow the buckets."""
    stats = np.arange(BUCKETS, BUCKETS + N_STATS, dtype=np.int32)
    ids = np.concatenate([np.concatenate([i, stats]) for i, _, _ in rows])
    x = np.concatenate([np.concatenate([v, np.asarray(s, np.float32)]) for _, v, s in rows])
    doc = np.repeat(np.arange(len(rows)), [len(i) + N_STATS for i, _, _ in rows])
    return ids, x, doc


def fit(rows: list[dict]) -> dict:
    """Adagrad on the logistic loss, in blocks of documents."""
    n_in = BUCKETS + N_STATS
    rng = np.random.default_rng(11)
    m = Machine(0.0, np.zeros(n_in), rng.normal(0, 0.02, (n_in, RANK)))
    if not rows:
        return {"w0": 0.0, "w": m.w.tolist(), "v": np.zeros(n_in * RANK).tolist()}
    data = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["x"], np.float32), r["stats"]) for r in rows]
    y = np.array([r["y"] for r in rows], np.float64)
    seen = np.bincount(np.concatenate([d[0] for d in data]), minlength=n_in)
    data = [(i[seen[i] >= MIN_DOCS], x[seen[i] >= MIN_DOCS], s) for i, x, s in data]
    m.v[:BUCKETS][seen[:BUCKETS] < MIN_DOCS] = 0
    mean = np.clip(y.mean(), 0.01, 0.99)
    m.w0 = float(np.log(mean / (1 - mean)))
    gw, gv, g0 = np.full(n_in, 1e-6), np.full((n_in, RANK), 1e-4), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(data))
        for at in range(0, len(order), 128):
            some = order[at:at + 128]
            ids, x, doc = _inputs([data[i] for i in some])
            z, s = m.raw(ids, x, doc, len(some))
            d = (1 / (1 + np.exp(-z)) - y[some]) / len(some)
            used, back = np.unique(ids, return_inverse=True)
            dx = d[doc] * x
            grad = np.bincount(back, dx, len(used)) + L2_WORDS * m.w[used]
            gw[used] += grad ** 2
            m.w[used] -= RATE * grad / np.sqrt(gw[used])
            inner = dx[:, None] * (s[doc] - m.v[ids] * x[:, None])
            grad = np.stack([np.bincount(back, inner[:, f], len(used)) for f in range(RANK)], axis=1) + L2_WORDS * m.v[used]
            gv[used] += grad ** 2
            m.v[used] -= RATE * grad / np.sqrt(gv[used])
            g0 += d.sum() ** 2
            m.w0 -= RATE * float(d.sum()) / np.sqrt(g0)
    return {"w0": float(m.w0), "w": m.w.tolist(), "v": m.v.ravel().tolist()}


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", n: int = SAMPLE) -> Machine:
    def run(batch):
        rows = batch.to_pylist()
        words = [words_of(r["text"]) for r in rows]
        return {"doc_id": batch.column("doc_id"), "y": batch.column("y"), "ids": [i.tobytes() for i, _ in words],
                "x": [x.tobytes() for _, x in words], "stats": [statistics(r["text"], r.get("n_chars")) for r in rows]}

    features = in_batches(sample(docs, labels, target, n), "doc_id long, y int, ids binary, x binary, stats array<double>", run)
    model = fit_in_one_task(features, fit, "w0 double, w array<double>, v array<double>")
    return Machine(model["w0"], np.array(model["w"]), np.array(model["v"]).reshape(-1, RANK))


def quality(docs: DataFrame, labels: DataFrame, n: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    m = train(docs, labels, "quality", n)
    shared = docs.sparkSession.sparkContext.broadcast((m.w0, m.w, m.v))  # BUCKETS and RANK bound its size

    def run(texts: list[str], n_chars: list) -> dict:
        m = Machine(*shared.value)
        out: list[float] = []
        for at in range(0, len(texts), 64):
            rows = [(*words_of(t), statistics(t, n)) for t, n in zip(texts[at:at + 64], n_chars[at:at + 64])]
            z, _ = m.raw(*_inputs(rows), len(rows))
            out += (1 / (1 + np.exp(-np.clip(z, -500, 500)))).tolist()
        return {"score": out}

    found = score_texts(docs, "score double", run)
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).select("doc_id", "held_out", "score", "predicted")
