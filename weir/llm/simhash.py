"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint becomes the point of the bit counts of its two-bit segments. The
Manhattan distance of two points never exceeds the bits in which the fingerprints differ,
so near fingerprints are near points. The range join on the points uses a grid: the
coordinates are cut into ``radius + 2`` blocks, and points within ``radius`` agree in at
least two blocks, so every pair of blocks with its coordinates is a cell. Pairs that share
a cell pass the Manhattan bound and then the exact bit count.

Only distinct fingerprints are joined, so copies cost nothing. A cell with more than
``crowd`` fingerprints is not paired: its members go to an exact join without pairs, in
which every fingerprint is linked to the smallest one that touches a common ball point
(fingerprints within an even radius r have a common point within r/2 of both).

Null and wordless texts have fingerprint zero and are linked like any other. Rows without
doc_id get a fingerprint and a component, but give a component no id; repeated rows give
repeated results; extra columns are ignored.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..storage import written
from .common import in_batches, whole_text
from .graph import components

SEED = 42
SHINGLE = 3
RADIUS = 2
CROWD = 32
#: Shingles hashed at a time, which bounds the memory of a very long text.
AT_ONCE = 100_000

_hash = partial(xxhash.xxh64_digest, seed=SEED)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint; a bit is set if it is set in more than half the shingle hashes."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(grams), AT_ONCE):
        digests = b"".join(map(_hash, grams[at:at + AT_ONCE]))
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(grams)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp of every row."""
    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "fp": [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]}

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return in_batches(texts, "doc_id long, fp long", run)


def _count(fp: Column, segment: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, 2 * segment).bitwiseAND(F.lit(3)))


def cells(fps: DataFrame, radius: int) -> DataFrame:
    """cell, fp: the grid cells of each fingerprint, one for every pair of coordinate blocks."""
    blocks = [list(map(int, b)) for b in np.array_split(np.arange(32), radius + 2)]
    code = [sum((_count(F.col("fp"), s) * F.lit(3 ** i).cast("long") for i, s in enumerate(b)), F.lit(0).cast("long")) for b in blocks]
    coded = fps.select("fp", *[c.alias(f"b{i}") for i, c in enumerate(code)])
    keys = [F.struct(F.lit(n).alias("n"), F.col(f"b{i}").alias("x"), F.col(f"b{j}").alias("y"))
            for n, (i, j) in enumerate(combinations(range(len(blocks)), 2))]
    return coded.select("fp", F.explode(F.array(*keys)).alias("cell")).select("cell.n", "cell.x", "cell.y", "fp")


def _manhattan(a: Column, b: Column) -> Column:
    return sum((F.abs(_count(a, s) - _count(b, s)) for s in range(1, 32)), F.abs(_count(a, 0) - _count(b, 0)))


def _balls(fps: DataFrame, radius: int) -> DataFrame:
    """Links among ``fps`` by common ball points; linear in the fingerprints."""
    flips = [0, *(sum(1 << b for b in bits) for k in range(1, radius // 2 + 1) for bits in combinations(range(64), k))]
    masks = F.array(*[F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long") for x in flips])
    points = fps.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
    low = points.groupBy("point").agg(F.min("fp").alias("low"))
    return points.join(low, "point").filter("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def links(fps: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """a, b: links between distinct fingerprints that connect all those within ``radius`` bits.
    ``radius`` is even. ``fps`` is a written table of distinct values ``fp``."""
    if radius % 2:
        raise ValueError("radius must be even")
    keyed = written(cells(fps, radius), "cells")
    at = ["n", "x", "y"]
    full = written(keyed.groupBy(*at).agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "full-cells")
    few = keyed.join(full.filter(F.col("members") <= crowd).select(*at), at)
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), at).filter("a < b")
    near = pairs.filter(_manhattan(F.col("a"), F.col("b")) <= radius).filter(
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    crowded = keyed.join(full.filter(F.col("members") > crowd).select(*at), at).select("fp").distinct()
    return near.unionByName(_balls(crowded, radius)).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links) of every row."""
    fps = written(fingerprints(docs, shingle), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprint-classes")
    member = components(links(classes.select("fp"), radius, crowd))
    rooted = classes.join(member, classes.fp == member.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def shown(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of the document with the smallest id of every group; rows that repeat an id count as
    one document. Of a group without any id nothing can be told apart, so all its rows stay."""
    found = near_duplicates(docs)
    keep = found.filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").unionByName(docs.filter("doc_id IS NULL"))
