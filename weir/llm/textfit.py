"""Labelled samples and sparse word features for the document classifiers.

Training takes a bounded sample: the ``n`` labelled, not held-out documents with the
smallest hash of their id. Its whole texts are turned to features in parallel; one task
fits the model on them and returns its parameters as one row, whose size is set by the
number of hash buckets.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_schema, held_out, in_batches, whole_text

BUCKETS = 1 << 17
#: Most labelled documents a model is fitted on.
SAMPLE = 16_000
REMEMBERED = 1_000_000
#: Words, and the characters that end a sentence.
TOKENS = re.compile(r"\w+|[.!?\n]")
ENDS = frozenset(".!?\n")


class Buckets(dict):
    """Token to hash bucket; -1 for the end of a sentence."""

    def __missing__(self, token: str) -> int:
        n = -1 if token in ENDS else crc32(token.lower().encode()) % BUCKETS
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = n
        return n


_buckets = Buckets()


def token_ids(text: str) -> np.ndarray:
    b = _buckets
    return np.array([b[t] for t in TOKENS.findall(text)], np.int32)


def sample(docs: DataFrame, labels: DataFrame, target: str, n: int = SAMPLE) -> DataFrame:
    """doc_id, y, text of the sampled documents. Of several labels for a document the larger counts;
    rows without a label of 0 or 1 are passed over."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).filter(
        F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
    one = usable.groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)  # n bounds the broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c for c in ("n_chars",) if c in docs.columns], whole_text().alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")


def fit_in_one_task(features: DataFrame, fit: Callable[[list[dict]], dict], schema: str) -> dict:
    """Runs ``fit`` on the feature rows, in a fixed order, in one task and returns its only row.
    ``features`` is bounded by the sample."""
    arrow = arrow_schema(features.sparkSession, schema)

    def run(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (r["doc_id"], r["y"], r["ids"]))
        out = fit(rows)
        yield pa.RecordBatch.from_arrays([pa.array([out[x.name]], x.type) for x in arrow], schema=arrow)

    # one partition even if the sample is empty, so that there is always a model
    one = features.repartition(1)
    found = one.mapInArrow(run, schema).collect()
    return found[0].asDict() if found else fit([])


def score_texts(docs: DataFrame, schema: str, f: Callable[[list[str], list], dict]) -> DataFrame:
    """doc_id, held_out and what ``f(texts, n_chars)`` gives for every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), whole_text().alias("text"),
                        (F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")).alias("n_chars"))

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "held_out": batch.column(1)} | f(batch.column(2).to_pylist(), batch.column(3).to_pylist())

    return in_batches(texts, f"doc_id long, held_out boolean, {schema}", run)
