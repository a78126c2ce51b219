"""Whitening of embeddings by spectral divide and conquer.

The distinct integer vectors are summed and then, centred, multiplied: two passes over a
written table, each of which leaves one partial sum per task. The d x d covariance is taken
apart by QDWH: the polar factor of the shifted matrix gives the projector on the components
above the shift, an orthogonal basis of both halves gives two smaller matrices, and so on
until a matrix is a multiple of the identity. Two refinement steps bring the components to
double precision. The components (d x ``most``) then travel to the rows, whose number never
matters on the driver.

Rows whose vector is null, empty, or holds a null or non-finite component take no part. Of
vectors of several lengths those of the most frequent length (the longest of several) count.
Repeated vectors count once in the fit, and every row gets its result; a null vec_id is kept.
Components without variance (fewer distinct vectors than dimensions, equal vectors) have no
whitened values and are left out, so one vector alone gives no rows. Extra columns are
ignored. A deviation beyond 64 bits is null. Components beyond 64 bits saturate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..storage import written
from .common import arrow_schema

EPS = np.finfo(float).eps
#: Components are multiplied by SCALE, rounded down and moved by SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components that are returned.
MOST = 16


# ---------------------------------------------------------------- symmetric matrices

def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix by the dynamically weighted Halley iteration:
    weights follow a lower bound of the singular values, so six steps do for any condition. QR steps
    while the weights are large, Cholesky steps after."""
    d = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 0.9 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(max(low, EPS), 1.0)
    one = np.eye(d)
    for _ in range(20):
        l2 = low * low
        g = np.cbrt(4 * (1 - l2) / (l2 * l2))
        h = np.sqrt(1 + g) + 0.5 * np.sqrt(8 - 4 * g + 8 * (2 - l2) / (l2 * np.sqrt(1 + g)))
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        if c > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(c) * x, one]))[0]
            new = b / c * x + (h - b / c) / np.sqrt(c) * q[:d] @ q[d:].T
        else:
            new = b / c * x + (h - b / c) * np.linalg.solve(one + c * x.T @ x, x.T).T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(low * (h + b * l2) / (1 + c * l2), 1.0)
        if moved < np.cbrt(EPS) and 1 - low < 10 * EPS:
            break
    return x


def split(a: np.ndarray, shift: float) -> tuple[float, np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below ``shift`` and what is left between them; None
    if all lies on one side."""
    d = len(a)
    projector = (polar(a - shift * np.eye(d)) + np.eye(d)) / 2
    k = int(round(np.trace(projector)))
    if not 0 < k < d:
        return None
    upper = np.linalg.qr(projector @ np.random.default_rng(d).normal(size=(d, k)))[0]
    q = np.linalg.qr(projector @ upper, mode="complete")[0]
    upper, lower = q[:, :k], q[:, k:]
    return float(np.linalg.norm(lower.T @ a @ upper)), upper, lower


def divided(a: np.ndarray, size: float) -> np.ndarray:
    """Orthogonal matrix whose columns make ``a`` diagonal; ``size`` is the norm of the whole matrix."""
    d = len(a)
    middle = np.trace(a) / d
    if d == 1 or np.linalg.norm(a - middle * np.eye(d)) <= d * EPS * size:
        return np.eye(d)
    best = None
    on_line = np.sort(np.diag(a))
    for shift in dict.fromkeys((float(np.median(on_line)), float(middle), *map(float, (on_line[1:] + on_line[:-1]) / 2))):
        found = split(a, shift)
        if found and (best is None or found[0] < best[0]):
            best = found
        if best and best[0] <= 10 * d * EPS * size:
            break
    if best is None:
        return np.eye(d)
    halves = [basis @ divided((part + part.T) / 2, size) for basis in best[1:] for part in [basis.T @ a @ basis]]
    return np.hstack(halves)


def refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and vectors after one correction of nearly orthogonal, nearly diagonalising vectors."""
    r, s = np.eye(len(a)) - x.T @ x, x.T @ a @ x
    values = np.diag(s) / (1 - np.diag(r))
    rest = s - np.diag(values)
    near = 2 * (np.linalg.norm(rest, 2) + np.linalg.norm(a) * np.linalg.norm(r, 2)) + EPS * np.linalg.norm(a)
    apart = values[None, :] - values[:, None]
    close = np.abs(apart) <= near
    step = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1.0, apart))
    return values, x + x @ step


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values, falling, and unit vectors (columns) of a symmetric matrix."""
    if not a.size or not np.linalg.norm(a):
        return np.zeros(len(a)), np.eye(len(a))
    size = float(np.linalg.norm(a))
    x = divided(a / size, 1.0)
    for step in range(4):
        if step < 2:
            _, x = refined(a / size, x)
        x = x @ (3 * np.eye(len(a)) - x.T @ x) / 2  # towards the nearest orthogonal matrix
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


# ---------------------------------------------------------------- passes over vectors

def integers(embeddings: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id and the integer vector ``x`` of the rows that take part."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    usable = embeddings.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    x = F.transform("embedding", lambda c: F.floor(scale * c.cast("double")).cast("long") + shift)
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def rows_of(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index(name))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), d)


def summed(vectors: DataFrame, f: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], d: int, kind: str) -> np.ndarray:
    """The sum of ``f`` (matrices of ``shape``) over all batches of ``x``: one partial matrix per task, added up by Spark."""
    arrow = arrow_schema(vectors.sparkSession, f"i int, v array<{kind}>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = f(rows_of(batch, "x", d))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), arrow[1].type)], schema=arrow)

    parts = vectors.select("x").mapInArrow(run, f"i int, v array<{kind}>").select("i", F.posexplode("v").alias("j", "v"))
    out = np.zeros(shape, np.int64 if kind == "long" else float)
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # as many rows as the matrix has cells
        out[r["i"], r["j"]] = r["v"]
    return out


def halves(x: np.ndarray) -> np.ndarray:
    """Upper and lower words of the sums, which stay exact for components of any size, and the count."""
    count = np.full(x.shape[1], len(x))
    return np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), count])


class Centre:
    """Exact sums of the fit vectors and what follows from them for others."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = [(2 * s + n) // (2 * n) for s in sums]  # the mean, rounded
        self.rest = [s - n * w for s, w in zip(sums, self.whole)]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.whole)).astype(float) - np.array(self.rest, float) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - sum)^2, exact; None beyond 64 bits."""
        off = x - np.array(self.whole)
        reach = float(np.abs(off.astype(float)).max(initial=0)) * self.n + self.n
        if reach * reach * x.shape[1] < 2.0 ** 62:
            return ((off * self.n - np.array(self.rest)) ** 2).sum(1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums)) for row in x]
        return [v if v < 1 << 63 else None for v in exact]


def whitened(embeddings: DataFrame, most: int = MOST, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    names = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = embeddings.sparkSession
    vectors = integers(embeddings, scale, shift)
    length = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    d = length["d"]
    vectors = vectors.filter(F.size("x") == d)
    fit = written(vectors.select("x").distinct(), "fit-vectors")
    high, low, count = summed(fit, halves, (3, d), d, "long").tolist()
    centre = Centre(count[0], [(h << 32) + v for h, v in zip(high, low)])
    cov = summed(fit, lambda x: (lambda y: y.T @ y)(centre.centred(x)), (d, d), d, "double") / centre.n
    values, axes = components((cov + cov.T) / 2)
    total = float(np.trace(cov))
    some = [k for k in range(min(most, d)) if values[k] > 64 * d * EPS * max(values[0], 0.0)]
    if not some:
        return spark.createDataFrame([], schema)
    k = len(some)
    lens = axes[:, :k] / np.sqrt(values[:k])
    explained = values[:k] / total

    def again(x: np.ndarray) -> np.ndarray:
        w = np.hstack([centre.centred(x) @ lens, np.ones((len(x), 1))])
        return w.T @ w

    square = summed(fit, again, (k + 1, k + 1), d, "double") / centre.n
    error = float(np.abs(square[:k, :k] - np.outer(square[k, :k], square[k, :k]) - np.eye(k)).max())
    arrow = arrow_schema(spark, schema)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, m = rows_of(part, "x", d), part.num_rows
                each = pa.array(np.repeat(np.arange(m), k))
                out = {"vec_id": part.column(0).take(each), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m), "n": np.full(m * k, centre.n),
                       "deviation": pa.array(centre.deviations(x), pa.int64()).take(each), "whitened": (centre.centred(x) @ lens).ravel(),
                       "explained": np.tile(explained, m), "identity_error": np.full(m * k, error)}
                yield pa.RecordBatch.from_arrays([pa.array(out[c]) if not isinstance(out[c], pa.Array) else out[c] for c in names], schema=arrow)

    return vectors.mapInArrow(project, schema)
