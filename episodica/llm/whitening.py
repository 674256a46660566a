"""Whitening of embeddings with eigenvectors refined from single precision.

The covariance is summed over the cluster: entries become whole numbers, each distinct
vector counts once, and every task adds up the outer products of its centred
vectors; only sums of the size of the dimensions leave the tasks. The eigenvectors of the
single-precision covariance start an iteration of matrix multiplications in higher
precision (Ogita and Aishima, 2018, 2019): from the residuals of orthogonality and of
diagonality it adds a first-order correction, so the error squares in each round.
Eigenvalues closer than the residual allows to tell apart form a cluster; within it the correction
only restores orthogonality, and a small eigenproblem of the cluster, shifted by its
mean, turns its vectors to where the next rounds can tell them apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.shared import staged

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Rounds of refinement; each squares the error, so single precision needs two or three and clusters a few more.
ROUNDS = 12
#: Eigenvalues below this part of the largest are rounding and count as zero.
NOTHING = 1e-13
#: Entries of a chunk of vectors that a task holds as double precision.
CHUNK = 1 << 20
_LONG = np.iinfo(np.int64)


class Fit(NamedTuple):
    """What is known of the distinct vectors: their number, sums by dimension and covariance (divisor n)."""

    n: int
    sums: list[int]
    covariance: np.ndarray


class Basis(NamedTuple):
    """Unit eigenvectors as columns and eigenvalues, by falling eigenvalue."""

    vectors: np.ndarray
    values: np.ndarray


def whole_vectors(rows: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, x): entries times 64, rounded down, plus a million, as longs; vectors that are null or have null or non-finite entries go.

    So do vectors that are empty or whose length is not the commonest (of equally common ones the largest).
    """
    entry = F.col("v")
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    bad = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(entry, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return rows.where(entry.isNotNull() & (F.size(entry) > 0) & ~bad).select("id", whole.alias("x"))


def _commonest(rows: DataFrame) -> DataFrame:
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == (sizes[0]["d"] if sizes else 0))


def _chunks(batches: Iterator[pa.RecordBatch], column: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of batches with their vectors as a matrix."""
    step = max(1, CHUNK // d)
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            yield part, part.column(column).flatten().to_numpy().reshape(-1, d)


def _sums(d: int):
    """Number and sums by dimension of a task's vectors."""

    def task(batches):
        n, total = 0, np.zeros(d, np.int64)
        for _, x in _chunks(batches, 0, d):
            n += len(x)
            total += x.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.int64()))], ["n", "sums"])

    return task


def _centred(x: np.ndarray, n: int, sums: Sequence[int]) -> np.ndarray:
    """x - sums / n: the whole parts of the means are taken off exactly."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def _outer(d: int, n: int, sums: Sequence[int]):
    """Sum of the outer products of a task's centred vectors, a row of the matrix per result row."""

    def task(batches):
        total = np.zeros((d, d))
        for _, x in _chunks(batches, 0, d):
            y = _centred(x, n, sums)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    return task


def fit(distinct: DataFrame) -> Fit | None:
    """Number, sums and covariance of the vectors ``x`` of a table; None of an empty one."""
    first = distinct.select(F.size("x")).first()
    if first is None:
        return None
    d = first[0]
    parts = distinct.select("x").mapInArrow(_sums(d), "n long, sums array<long>")
    # one number per dimension reaches the driver
    n = 0
    sums = [0] * d
    for r in parts.select("n", F.posexplode("sums")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s")).collect():
        n, sums[r["pos"]] = r["n"], r["s"]
    rows = distinct.select("x").mapInArrow(_outer(d, n, sums), "i long, row array<double>")
    cells = rows.select("i", F.posexplode("row")).groupBy("i", "pos").agg(F.sum("col").alias("v"))
    cells = cells.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("row")).select("i", F.col("row.v").alias("row"))
    covariance = np.zeros((d, d))
    for r in cells.collect():  # d rows of d numbers
        covariance[r["i"]] = r["row"]
    return Fit(n, sums, (covariance + covariance.T) / (2 * n))


def _residual(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Residuals of orthogonality and diagonality, the eigenvalues they suggest, and the least gap that they can tell."""
    r = np.eye(len(a)) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    return r, s, values, float(2 * (np.linalg.norm(off, 2) + np.linalg.norm(a, 2) * np.linalg.norm(r, 2)))


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of neighbouring eigenvalues that are closer than ``gap``, in falling order; single ones are left out."""
    order = np.argsort(-values, kind="stable")
    cut = np.flatnonzero(-np.diff(values[order]) > gap) + 1
    return [run for run in np.split(order, cut) if len(run) > 1]


def refine(a: np.ndarray, x: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Eigenvectors of the symmetric ``a`` from approximate ones ``x``.

    A round multiplies matrices in the precision of ``a``; rounds end when the correction is down to rounding or grows no smaller.
    """
    eps = np.finfo(a.dtype).eps
    before = np.inf
    for _ in range(rounds):
        r, s, values, gap = _residual(a, x)
        apart = values[None, :] - values[:, None]
        told = np.abs(apart) > gap
        e = np.where(told, (s + values[None, :] * r) / np.where(told, apart, 1), r / 2)
        x = x + x @ e
        for run in _clusters(values, gap):
            # the cluster's own problem, shifted so that its differences are not lost in its size
            part = x[:, run]
            shift = values[run].mean()
            small = part.T @ (a @ part - shift * part)
            x[:, run] = part @ np.linalg.eigh((small + small.T) / 2)[1][:, ::-1]
        size = np.abs(e).max()
        if size < 8 * eps * len(a) or (size >= before and size < np.sqrt(eps)):
            break
        before = size
    return x


def eigenvectors(a: np.ndarray) -> Basis:
    """All eigenvectors of a symmetric matrix: single precision first, then refinement in double and in extended precision."""
    a = np.asarray(a, np.float64)
    scale = np.abs(a).max() or 1.0
    a = a / scale
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    x = refine(a, start)
    # what a round in double precision leaves is its own rounding; one round with longer products takes that off
    wide, y = a.astype(np.longdouble), x.astype(np.longdouble)
    r = np.eye(len(a)) - y.T @ y
    s = y.T @ (wide @ y)
    values = np.diag(s) / (1 - np.diag(r))
    apart = values[None, :] - values[:, None]
    gap = 2 * (np.linalg.norm((s - np.diag(values)).astype(np.float64), 2) + np.linalg.norm(r.astype(np.float64), 2))
    told = np.abs(apart) > gap
    e = np.where(told, (s + values[None, :] * r) / np.where(told, apart, 1), r / 2)
    x = (y + y @ e).astype(np.float64)
    x /= np.linalg.norm(x, axis=0)
    values = values.astype(np.float64)
    order = np.argsort(-values, kind="stable")
    return Basis(x[:, order], values[order] * scale)


def _weights(basis: Basis, components: int) -> np.ndarray:
    """Columns that project a centred vector to unit variance; none for eigenvalues of zero."""
    e = basis.values[:components]
    known = e > max(basis.values[0], 0) * NOTHING * len(basis.values)
    return np.where(known, basis.vectors[:, :components] / np.sqrt(np.where(known, e, 1)), np.nan)


def _moments(d: int, n: int, sums: Sequence[int], weights: np.ndarray):
    """Sums and products of a task's whitened vectors."""
    k = weights.shape[1]

    def task(batches):
        total, products = np.zeros(k), np.zeros((k, k))
        for _, x in _chunks(batches, 0, d):
            z = _centred(x, n, sums) @ weights
            total += z.sum(0)
            products += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total, products.ravel()]).tolist()], pa.list_(pa.float64()))], ["v"])

    return task


def identity_error(distinct: DataFrame, found: Fit, weights: np.ndarray) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    known = ~np.isnan(weights).any(0)
    w = weights[:, known]
    k = w.shape[1]
    if not k:
        return 0.0
    sums = distinct.select("x").mapInArrow(_moments(len(found.sums), found.n, found.sums, w), "v array<double>")
    out = np.zeros(k + k * k)
    for r in sums.select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("s")).collect():
        out[r["pos"]] = r["s"]
    mean = out[:k] / found.n
    return float(np.abs(out[k:].reshape(k, k) / found.n - np.outer(mean, mean) - np.eye(k)).max())


def _deviation(x: np.ndarray, n: int, sums: Sequence[int]) -> list[int | None]:
    """Sum of (n x - sums)^2 over the dimensions, exact; None where it does not fit a long."""
    bound = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums)) if len(x) else 0
    if bound < 1 << 62:
        gap = n * x - np.array(sums, np.int64)
        if x.shape[1] * int(np.abs(gap).max(initial=0)) ** 2 <= _LONG.max:
            return (gap * gap).sum(1).tolist()
        gaps = gap.tolist()
    else:
        gaps = [[n * c - s for c, s in zip(row, sums)] for row in x.tolist()]
    exact = [sum(g * g for g in row) for row in gaps]
    return [v if v <= _LONG.max else None for v in exact]


def _project(d: int, found: Fit, weights: np.ndarray, explained: np.ndarray, error: float):
    k = weights.shape[1]

    def task(batches):
        for part, x in _chunks(batches, 1, d):
            m = len(x)
            z = _centred(x, found.n, found.sums) @ weights
            far = pa.array(_deviation(x, found.n, found.sums), pa.int64())
            owner = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(owner), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, found.n)),
                far.take(owner), pa.array(z.ravel(), from_pandas=True), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ], _WHITENED_NAMES)

    return task


_WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_WHITENED_NAMES = [c.split()[0] for c in _WHITENED.split(", ")]


def whiten(rows: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    Defined cases: vectors that are null or empty, have null or non-finite entries or another length than the commonest are
    left out; repeated vectors count once in the fit and each have their rows, as null and repeated ids have; a component
    whose eigenvalue is zero (fewer distinct vectors than components, constant dimensions) has a null ``whitened`` and does
    not count in ``identity_error``; equal eigenvalues may give any basis of their space, the same for all rows; a deviation
    beyond a long is null; entries beyond a long stop at its ends; there are at most as many components as dimensions; further columns are ignored;
    an empty table gives an empty result.

    The driver holds matrices of the size of the dimensions squared, never vectors.
    """
    spark = rows.sparkSession
    whole = _commonest(whole_vectors(rows, id_column, column))
    distinct = staged(whole.select("x").distinct(), "vectors")
    found = fit(distinct)
    if found is None:
        return spark.createDataFrame([], _WHITENED)
    d = len(found.sums)
    basis = eigenvectors(found.covariance)
    weights = _weights(basis, min(components, d))
    trace = float(np.trace(found.covariance))
    explained = np.maximum(basis.values[: weights.shape[1]], 0) / trace if trace > 0 else np.zeros(weights.shape[1])
    error = identity_error(distinct, found, weights)
    return whole.select("id", "x").mapInArrow(_project(d, found, weights, explained, error), _WHITENED)
