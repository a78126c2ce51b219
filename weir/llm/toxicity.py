"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and only the bag has a label. Each sentence has the
probability sigmoid(bias + sum of its words' weights); the document's is their noisy-or
with a leak, 1 - (1 - p0) prod(1 - p). Weights are fitted to the document labels through
the noisy-or, so the model learns which sentences carry the label, and scoring can point at
them. The leak stands for labels that no sentence explains, so that mislabelled documents
do not pull on their words.

Null and empty texts, and texts without words, have no sentence and score the leak. Rows are
scored independently: repeated rows get equal scores; a null doc_id is kept (and counts as
held out). Without any labelled row all weights are zero and only bias and leak are left. Extra
columns of either table are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import in_batches
from .textfit import BUCKETS, ENDS, SAMPLE, TOKENS, fit_in_one_task, sample, score_texts, token_ids

THRESHOLD = 0.3
#: A sentence is pointed at from this probability.
SENTENCE_THRESHOLD = 0.2
EPOCHS = 25
BLOCK = 64
RATE = 0.5
#: Buckets in fewer training documents keep weight zero.
MIN_DOCS = 4
L2 = 1e-5
START = -6.0
LEAK = -3.0


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _sigmoid(z):
    return np.exp(-_softplus(-z))


def sentences(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, the sentence of each word, and the number of each sentence that has words."""
    ends = ids < 0
    number = np.cumsum(ends)[~ends]
    words = ids[~ends]
    kept, inverse = np.unique(number, return_inverse=True)
    return words, inverse, kept


def fit(rows: list[dict]) -> dict:
    """Weights, bias and leak by Adagrad on the noisy-or likelihood, in passes over blocks of documents."""
    bags = [sentences(np.frombuffer(r["ids"], np.int32)) for r in rows]
    y = np.array([r["y"] for r in rows], np.float64)
    seen = np.zeros(BUCKETS)
    for words, _, _ in bags:
        seen[np.unique(words)] += 1
    used = np.flatnonzero(seen >= MIN_DOCS)
    place = np.full(BUCKETS, len(used))  # rarer words share a last place, whose weight stays zero
    place[used] = np.arange(len(used))
    bags = [(place[words], sent, kept) for words, sent, kept in bags]
    w, g2 = np.zeros(len(used) + 1), np.full(len(used) + 1, 1e-6)
    shared, shared_g2 = np.array([START, LEAK]), np.full(2, 1e-4)
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BLOCK):
            some = order[at:at + BLOCK]
            n_sent = np.array([len(bags[i][2]) for i in some])
            doc = np.repeat(np.arange(len(some)), n_sent)
            first = np.cumsum(n_sent) - n_sent
            words = np.concatenate([bags[i][0] for i in some])
            sent = np.concatenate([bags[i][1] + f for i, f in zip(some, first)])
            z = shared[0] + np.bincount(sent, w[words], len(doc))
            s = np.bincount(doc, _softplus(z), len(some)) + _softplus(shared[1])
            pull = np.where(y[some] == 1, -1.0 / np.maximum(np.expm1(np.minimum(s, 500)), 1e-6), 1.0) / len(some)
            d = pull[doc] * _sigmoid(z)
            grad = np.bincount(words, d[sent], len(w)) + L2 * w
            grad[-1] = 0
            g2 += grad ** 2
            w -= RATE * grad / np.sqrt(g2)
            both = np.array([d.sum(), pull.sum() * _sigmoid(shared[1])])
            shared_g2 += both ** 2
            shared -= RATE / 5 * both / np.sqrt(shared_g2)
    every = np.zeros(BUCKETS)
    every[used] = w[:-1]
    return {"w": every.tolist(), "bias": float(shared[0]), "leak": float(shared[1])}


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", n: int = SAMPLE) -> tuple[np.ndarray, float, float]:
    def run(batch):
        return {"doc_id": batch.column("doc_id"), "y": batch.column("y"), "ids": [token_ids(t).tobytes() for t in batch.column("text").to_pylist()]}

    features = in_batches(sample(docs, labels, target, n).select("doc_id", "y", "text"), "doc_id long, y int, ids binary", run)
    model = fit_in_one_task(features, fit, "w array<double>, bias double, leak double")
    return np.array(model["w"]), model["bias"], model["leak"]


def _score(ids: list[np.ndarray], w: np.ndarray, bias: float, leak: float) -> list[tuple[float, np.ndarray, np.ndarray]]:
    out = []
    for x in ids:
        words, sent, numbers = sentences(x)
        z = bias + np.bincount(sent, w[words], len(numbers)) if len(numbers) else np.zeros(0)
        out.append((float(-np.expm1(-_softplus(z).sum() - _softplus(leak))), numbers, _sigmoid(z)))
    return out


def toxicity(docs: DataFrame, labels: DataFrame, n: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, and the numbers (from 0) and probabilities of offending sentences."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, "toxic", n))  # BUCKETS bounds its size

    def run(texts: list[str], _) -> dict:
        scored = _score([token_ids(t) for t in texts], *shared.value)
        hit = [p >= SENTENCE_THRESHOLD for _, _, p in scored]
        return {"score": [s for s, _, _ in scored], "offending": [n[h].tolist() for (_, n, _), h in zip(scored, hit)],
                "offending_p": [p[h].tolist() for (_, _, p), h in zip(scored, hit)]}

    found = score_texts(docs, "score double, offending array<int>, offending_p array<double>", run)
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).select(
        "doc_id", "held_out", "score", "predicted", "offending", "offending_p")


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end of every sentence, by the numbers that :func:`toxicity` reports."""
    out, at = [], 0
    for m in TOKENS.finditer(text):
        if m.group() in ENDS:
            out.append((at, m.end()))
            at = m.end()
    return [*out, (at, len(text))]


def offending_sentences(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, sentence, start, end, p, text of every offending sentence; ids are unique."""
    hits = found.filter(F.size("offending") > 0).select("doc_id", "offending", "offending_p")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("whole")).join(hits, "doc_id")

    def run(batch):
        out = {k: [] for k in ("doc_id", "sentence", "start", "end", "p", "text")}
        for r in batch.to_pylist():
            at = spans(r["whole"] or "")
            for i, p in zip(r["offending"], r["offending_p"]):
                a, b = at[i]
                for k, v in zip(out, (r["doc_id"], i, a, b, p, r["whole"][a:b])):
                    out[k].append(v)
        return out

    return in_batches(rows, "doc_id long, sentence int, start int, end int, p double, text string", run)
