"""Embedding whitening with components from QDWH spectral divide and conquer.

Vectors become integers x = floor(256 * c).  The fit list holds each different x once (they meet in
the partial aggregate, so a vector that a third of all rows hold is one row per task).  One pass gives
its exact sums, a second the covariance of the centred vectors: every task sends one matrix, and the
matrices are summed row by row, in two steps of groups, in the order of the tasks.

The covariance (dimensions x dimensions) is split on the driver: the polar factor U of the shifted
matrix V - s I, by the dynamically weighted Halley iteration, is a sign function, so (I + U) / 2
projects on the invariant subspace of the eigenvalues above s.  The two subspaces are split in turn
until blocks are single or multiples of the identity, and rotations polish what is left off the
diagonal.  The components are sent to all rows (dimensions x components), which are whitened in place.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; shorter
vectors are filled with zeros to the longest (an empty one is all zeros); entries beyond 64 bits stop
at the largest long; components whose eigenvalue is zero to double precision cannot be scaled to
variance 1 and are left out, so equal vectors, a single one or an empty table give an empty result;
equal eigenvalues give any orthonormal basis, the same for all rows; a deviation beyond 64 bits is
null; repeated rows and ids each get their own results; extra columns are carried along by
``transform`` and ignored by the query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.llm.common import keep, table

SCALE = 256
COMPONENTS = 4
EPS = float(np.finfo(float).eps)
GROUPS = 64  # of tasks whose matrices are summed first


# --- spectral divide and conquer --------------------------------------------------------------


def polar(a: np.ndarray, rounds: int = 30) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by weighted Halley steps (QDWH)."""
    eye = np.eye(len(a))
    x = a / max(np.abs(a).sum(0).max(), np.finfo(float).tiny)
    r = np.abs(np.diag(np.linalg.qr(x, mode="r"))).min()
    low = min(1.0, max(r / len(a), EPS / 8))  # below the least singular value, or as far as doubles tell
    for _ in range(rounds):
        q = low * low
        d = np.cbrt(4 * (1 - q) / (q * q))
        s = np.sqrt(1 + d)
        ha = s + np.sqrt(8 - 4 * d + 8 * (2 - q) / (q * s)) / 2
        hb = (ha - 1) ** 2 / 4
        hc = ha + hb - 1
        low = min(1.0, low * (ha + hb * q) / (1 + hc * q))
        if hc > 100:  # far from orthogonal: the stable form by a QR factorisation
            w = np.linalg.qr(np.vstack([np.sqrt(hc) * x, eye]))[0]
            new = hb / hc * x + (ha - hb / hc) / np.sqrt(hc) * w[: len(a)] @ w[len(a) :].T
        else:
            z = np.linalg.cholesky(eye + hc * x.T @ x)
            new = hb / hc * x + (ha - hb / hc) * np.linalg.solve(z.T, np.linalg.solve(z, x.T)).T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        if abs(1 - low) < 10 * EPS and moved < EPS ** (1 / 3):
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """(orthogonal basis, k): its first k columns span the invariant subspace above some shift."""
    m, norm = len(a), np.linalg.norm(a)
    diagonal = np.sort(np.diag(a))
    middles = (diagonal[1:] + diagonal[:-1]) / 2
    shifts = [float(np.median(diagonal)), float(diagonal.mean()), *middles[np.argsort(diagonal[:-1] - diagonal[1:], kind="stable")][:6]]
    start = np.random.default_rng(m).standard_normal((m, m))
    best = None
    for shift in shifts:
        try:
            project = (np.eye(m) + polar(a - shift * np.eye(m))) / 2
        except np.linalg.LinAlgError:
            continue
        k = int(round(np.trace(project)))
        if not 0 < k < m:
            continue
        upper, lower = start[:, :k], start[:, k:]
        for _ in range(2):  # subspace iteration with the projector
            upper = np.linalg.qr(project @ upper)[0]
            lower = np.linalg.qr(lower - project @ lower)[0]
        basis = np.linalg.qr(np.hstack([upper, lower]))[0]
        left = np.linalg.norm(basis[:, :k].T @ a @ basis[:, k:])
        if best is None or left < best[0]:
            best = (left, basis, k)
        if left <= 16 * m * EPS * norm:
            break
    return None if best is None else best[1:]


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix."""
    d = len(v)
    basis, scale = np.eye(d), np.linalg.norm(v)
    if d == 0 or scale == 0:
        return np.zeros(d), basis
    blocks = [(0, d)]
    while blocks:
        a, b = blocks.pop()
        own = basis[:, a:b]
        block = own.T @ v @ own
        block = (block + block.T) / 2
        if b - a < 2 or np.linalg.norm(block - np.eye(b - a) * np.trace(block) / (b - a)) <= 4 * EPS * scale:
            continue
        found = _split(block)
        if found:
            basis[:, a:b] = own @ found[0]
            blocks += [(a, a + found[1]), (a + found[1], b)]
    basis = np.linalg.qr(basis)[0]
    for _ in range(8):  # rotations for what rounding left off the diagonal
        w = basis.T @ v @ basis
        off = np.argwhere(np.triu(np.abs(w) > 2 * EPS * scale, 1))
        if not len(off):
            break
        for i, j in off:
            bi, bj = basis[:, i], basis[:, j]
            aij, aii, ajj = bi @ v @ bj, bi @ v @ bi, bj @ v @ bj
            if abs(aij) <= EPS * scale:
                continue
            angle = 0.5 * np.arctan2(2 * aij, aii - ajj)
            c, s = np.cos(angle), np.sin(angle)
            basis[:, i], basis[:, j] = c * bi + s * bj, c * bj - s * bi
    values = np.einsum("ij,ij->j", basis, v @ basis)
    order = np.argsort(-values, kind="stable")
    basis = basis[:, order] / np.linalg.norm(basis[:, order], axis=0)
    at = np.abs(basis).argmax(0)  # either sign: the largest entry is positive
    return values[order], basis * np.where(basis[at, np.arange(d)] < 0, -1.0, 1.0)


# --- the distributed part ---------------------------------------------------------------------


def finite(vector: Column) -> Column:
    """Whether a vector is there, and all its entries are numbers."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def integers(vector: Column, size: int) -> Column:
    """floor(256 * c) of every entry, filled with zeros to ``size`` entries."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    fill = F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), F.lit(size) - F.size(x)))
    return F.when(F.size(x) == size, x).otherwise(F.concat(x, fill))


def _matrix(column, size: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, size) if isinstance(column, pa.ChunkedArray) else column.flatten().to_numpy().reshape(-1, size)


def _largest(x: np.ndarray) -> float:
    """The largest size of an entry (the least long has no opposite)."""
    return max(-float(x.min()), float(x.max())) if x.size else 0.0


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, from the exact n * x - S where that fits."""
    mean = np.array([s / n for s in sums])
    if len(x) and _largest(x) * n + max(map(abs, sums)) < 2**62:
        return (x * n - np.array(sums, np.int64)) / float(n)
    return x - mean


def exact_sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """(rows, sums of each dimension) of the fit list, exact."""

    def run(batches):
        n, total = 0, [0] * size
        for batch in batches:
            x = _matrix(batch.column(0), size)
            high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()  # no overflow below 2**31 rows
            total = [t + (h << 32) + s for t, h, s in zip(total, high, low)]
            n += len(x)
        if n:
            wide = pa.array([str(t) for t in total], pa.string()).cast(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), wide], ["dim", "n", "total"])

    rows = fit.mapInArrow(run, "dim int, n long, total decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    sums = {r["dim"]: int(r["total"]) for r in rows}
    return (rows[0]["n"] if rows else 0), [sums.get(i, 0) for i in range(size)]


def scatter(fit: DataFrame, size: int, width: int, project) -> np.ndarray:
    """The sum of z zT over the fit list, z = ``project`` of its vectors (``width`` entries)."""

    def run(batches):
        total, n = np.zeros((width, width)), 0
        for batch in batches:
            z = project(_matrix(batch.column(0), size))
            total += z.T @ z
            n += len(z)
        if n:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([task] * width, pa.int64()), pa.array(range(width), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["task", "dim", "row"])

    def add(group):
        group = group.sort_by("task")
        return pa.table({"task": group.column("task")[:1], "dim": group.column("dim")[:1], "row": pa.array([_matrix(group.column("row"), width).sum(0).tolist()], pa.list_(pa.float64()))})

    schema = "task long, dim int, row array<double>"
    rows = fit.mapInArrow(run, schema)
    rows = rows.groupBy("dim", (F.col("task") % GROUPS).alias("group")).applyInArrow(add, schema)
    out = np.zeros((width, width))
    for r in rows.groupBy("dim").applyInArrow(add, schema).collect():
        out[r["dim"]] = r["row"]
    return (out + out.T) / 2


@dataclass(frozen=True)
class Whitening:
    """``axes``: unit eigenvectors as columns; ``values``: their eigenvalues, falling."""

    size: int
    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    axes: np.ndarray
    identity_error: float


def fit(vectors: DataFrame, vector: str = "embedding", most: int | None = COMPONENTS) -> Whitening:
    """The whitening of the different vectors of ``vectors`` by its first ``most`` components (None: all)."""
    rows = vectors.where(finite(F.col(vector)))
    size = rows.agg(F.max(F.size(vector))).first()[0] or 0
    x = keep(rows.select(integers(F.col(vector), size).alias("x")).distinct(), "fit-list")
    n, sums = exact_sums(x, size) if size else (0, [])
    if not n:
        return Whitening(size, 0, tuple(sums), 0.0, np.zeros(0), np.zeros((size, 0)), 0.0)
    v = scatter(x, size, size, lambda z: _centred(z, n, sums)) / n
    values, axes = components(v)
    real = values > size * EPS * max(values[0], 0.0)
    kept = int(min(real.sum(), size if most is None else most))
    values, axes = values[:kept], axes[:, :kept]
    scaled = axes / np.sqrt(values)
    error = 0.0
    if kept:
        ones = lambda z: np.hstack([_centred(z, n, sums) @ scaled, np.ones((len(z), 1))])
        got = scatter(x, size, kept + 1, ones) / n
        mean = got[:kept, kept]
        error = float(np.abs(got[:kept, :kept] - np.outer(mean, mean) - np.eye(kept)).max())
    return Whitening(size, n, tuple(sums), float(np.trace(v)), values, axes, error)


def transform(rows: DataFrame, model: Whitening, vector: str = "embedding", out: str = "whitening") -> DataFrame:
    """``rows`` with a finite vector, and their (deviation, whitened) in the struct ``out``."""
    sent = rows.sparkSession.sparkContext.broadcast((model.size, model.n, list(model.sums), model.axes / np.sqrt(model.values)))

    @F.arrow_udf("struct<deviation:bigint,whitened:array<double>>")
    def run(x: pa.Array) -> pa.Array:
        size, n, sums, scaled = sent.value
        x = _matrix(x, size) if size else np.zeros((len(x), 0), np.int64)
        far = _largest(x) * n + max(map(abs, sums), default=0)
        if far * far * max(size, 1) < 2**62:
            deviation = ((x * n - np.array(sums, np.int64)) ** 2).sum(1).tolist()
        else:
            deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
        white = _centred(x, n, sums) @ scaled if n else np.zeros((len(x), 0))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * scaled.shape[1], pa.int32()), pa.array(white.ravel(), pa.float64()))
        return pa.StructArray.from_arrays([pa.array([y if y < 2**63 else None for y in deviation], pa.int64()), lists], ["deviation", "whitened"])

    rows = rows.where(finite(F.col(vector)))
    return rows.withColumn(out, run(integers(F.col(vector), model.size)))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first four components."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(vectors)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    rows = transform(vectors, model).select("vec_id", "whitening.deviation", F.posexplode("whitening.whitened").alias("place", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
