"""Exact top-k inner products by a three-phase uniform threshold.

The components of a vector are split over ``parts`` nodes; a node's local score is the
inner product over its components, and a pair's score is the sum over the nodes.

1. Every node lists its ``k`` best candidates per query. The exact scores of the listed
   candidates give a cutoff: the k-th best of them, which no final result can fall below.
2. The cutoff goes out to the nodes. A candidate whose score reaches it must reach the
   ``parts``-th share of it in at least one node, so each node sends just those.
3. A sent candidate whose known scores plus the bound for the others stay below the cutoff
   is put aside; the rest get their exact scores, and each query keeps its best ``k``.

Nodes work on blocks (a block of queries against a block of vectors), so memory is bounded
by the block sizes. Of identical vectors only the ``k + 1`` smallest ids are candidates:
any other is beaten by ``k`` of the same score and a smaller id.

Components are floor(scale * x) with x as double. Vectors that are null or hold null, NaN
or infinite components take no part; an empty vector scores 0 with all. A shorter vector
counts as padded with zeros. Among rows that repeat a vec_id the smallest vector counts;
rows without vec_id take no part. Scores are 64-bit. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..storage import written

SCALE = 1024
PARTS = 2
QUERY_BLOCK = 4096
VECTOR_BLOCK = 4096
#: Inner products below this are exact in double precision.
EXACT = 2.0 ** 53


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: one row for every usable vec_id."""
    x = F.col("embedding")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    usable = embeddings.filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(good)
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; through double precision where that is exact."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if top < EXACT:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return q @ c.T


def _split(df: DataFrame, width: int, parts: int) -> DataFrame:
    """One row for each node with that node's components."""
    step = -(-width // parts)
    own = [F.struct(F.lit(p).alias("part"), F.slice("v", p * step + 1, step).alias("v")) for p in range(parts)]
    return df.withColumn("node", F.explode(F.array(*own))).drop("v").select("*", "node.part", "node.v").drop("node")


def _nodes(queries: DataFrame, candidates: DataFrame, f, schema: str):
    """``f(queries, candidates)`` for every node, block of queries and block of candidates."""
    on = ["part", "qb", "vb"]
    return queries.groupBy(*on).cogroup(candidates.groupBy(*on)).applyInPandas(f, schema)


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100, scale: int = SCALE, parts: int = PARTS,
          query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the queries whose vec_id is divisible by ``every``."""
    vectors = written(integer_vectors(embeddings, scale), "vectors")
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(1, width or 0)
    n_q = vectors.filter(F.col("vec_id") % every == 0).count()
    q_blocks, v_blocks = max(1, -(-n_q // query_block)), max(1, -(-n // vector_block))
    block = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")

    same = Window.partitionBy("v").orderBy("vec_id")
    distinct = vectors.withColumn("copy", F.row_number().over(same)).filter(F.col("copy") <= k + 1).drop("copy")
    blocks_of = lambda name, blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(name)
    cand = written(_split(distinct.select("vec_id", "v", block(v_blocks).alias("vb")), width, parts), "candidates")
    query = vectors.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", block(q_blocks).alias("qb"))
    cand_blocks = cand.select("*", blocks_of("qb", q_blocks))

    def scored(q: pd.DataFrame, c: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q_ids, c_ids = q["query_id"].to_numpy(np.int64), c["vec_id"].to_numpy(np.int64)
        most = max([len(v) for v in q["v"]] + [len(v) for v in c["v"]], default=0)
        return q_ids, c_ids, _scores(_matrix(q["v"], most), _matrix(c["v"], most))

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "part": [], "s": []})
        c = c.sort_values("vec_id", kind="stable")
        q_ids, c_ids, s = scored(q, c)
        s = np.where(q_ids[:, None] == c_ids, np.iinfo(np.int64).min, s)
        first = np.argsort(-s.astype(np.float64), axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(q_ids)), first.shape[1])
        out = pd.DataFrame({"query_id": q_ids[rows], "vec_id": c_ids[first.ravel()], "part": int(c["part"].iloc[0]), "s": s[rows, first.ravel()]})
        return out[out["query_id"] != out["vec_id"]]

    listed = _nodes(_split(query, width, parts).select("*", blocks_of("vb", v_blocks)), cand_blocks, best,
                    "query_id long, vec_id long, part int, s long")
    local = Window.partitionBy("query_id", "part").orderBy(F.desc("s"), "vec_id")
    local_best = listed.withColumn("r", F.row_number().over(local)).filter(F.col("r") <= k)
    first = exact_scores(local_best.select("query_id", "vec_id").distinct(), vectors)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    cut = (first.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
           .groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("cut")))
    cuts = written(cut, "cutoffs")  # queries with fewer than k other vectors: no cutoff, all are sent
    with_cut = _split(query.join(cuts, "query_id", "left"), width, parts).select("*", blocks_of("vb", v_blocks))

    def reaching(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "part": [], "s": []})
        q_ids, c_ids, s = scored(q, c)
        least = np.array([np.iinfo(np.int64).min if pd.isna(x) else -(-int(x) // parts) for x in q["cut"]], np.int64)
        i, j = np.nonzero((s >= least[:, None]) & (q_ids[:, None] != c_ids))
        return pd.DataFrame({"query_id": q_ids[i], "vec_id": c_ids[j], "part": int(c["part"].iloc[0]), "s": s[i, j]})

    sent = _nodes(with_cut, cand_blocks, reaching, "query_id long, vec_id long, part int, s long")
    known = sent.groupBy("query_id", "vec_id").agg(F.sum("s").alias("known"), F.count(F.lit(1)).alias("nodes")).join(cuts, "query_id", "left")
    below = F.ceil(F.col("cut") / parts) - 1  # what a node that did not send the pair can add at most
    open_pairs = known.filter(F.col("cut").isNull() | (F.col("known") + (parts - F.col("nodes")) * below >= F.col("cut")))
    complete = open_pairs.filter(F.col("nodes") == parts).select("query_id", "vec_id", F.col("known").alias("score"))
    rest = exact_scores(open_pairs.filter(F.col("nodes") < parts).select("query_id", "vec_id"), vectors)
    return (complete.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def exact_scores(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, vec_id, score of the given pairs."""
    q = vectors.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    both = pairs.join(q, "query_id").join(vectors, "vec_id")
    product = F.zip_with("qv", "v", lambda a, b: F.coalesce(a, F.lit(0)) * F.coalesce(b, F.lit(0)))
    return both.select("query_id", "vec_id", F.aggregate(product, F.lit(0).cast("long"), lambda s, x: s + x).alias("score"))
