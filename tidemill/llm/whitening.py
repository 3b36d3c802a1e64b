"""Whitening of embeddings by the leading components of their distributed, centred covariance.

Vectors become whole numbers, floor(scale * c) + shift, so that sums are exact. Tasks add up counts and sums, then, once the
means are known, products of centred entries; what leaves a task has the size of the covariance, not of its rows. The
covariance of d dimensions goes to the driver, d (d + 1) / 2 numbers, and is made tridiagonal by Householder reflections.
Bisection by Sturm counts gives its leading eigenvalues, inverse iteration its eigenvectors; those of eigenvalues that lie
close together are orthogonalised against each other at every step. The projection, d numbers for each component, is
broadcast, and tasks apply it to their rows.

Rows whose vector is null or holds null, NaN or infinite entries are left out. Null, repeated and equal ids and vectors are
rows of their own. Components without variance to double precision (of fewer rows than components, constant or dependent
dimensions) can't be whitened and are left out, so that equal rows alone, or a single one, give none. An empty table gives
an empty result. Vectors of different lengths, and entries that don't fit a long, are an error. A squared deviation
beyond a long is null. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LEAST = 1e-12  # of the trace: components of less variance count as none
_CLOSE = 1e-3  # of the norm: eigenvalues of a cluster are no farther apart


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of a symmetric matrix after Householder reflections, and their vectors, one for each column."""
    a, n, mirrors = np.array(matrix, np.float64), len(matrix), []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if np.any(v[1:]):
            v[0] += np.copysign(length, v[0])
            v /= np.linalg.norm(v)
            inner = a[k + 1 :, k + 1 :]
            p = inner @ v
            w = 2 * (p - (v @ p) * v)
            inner -= np.outer(v, w) + np.outer(w, v)
            a[k + 1, k] = -np.copysign(length, a[k + 1, k])
        else:
            v[:] = 0
        mirrors.append(v)
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), mirrors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix lie below each value."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    q, counts = np.ones(len(at)), np.zeros(len(at), np.int64)
    for x, y in zip(diagonal, np.insert(off * off, 0, 0), strict=True):
        with np.errstate(over="ignore"):  # an infinite quotient has the right sign
            q = x - at - y / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        counts += q < 0
    return counts


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection."""
    n = len(diagonal)
    around = np.abs(np.append(off, 0)) + np.abs(np.insert(off, 0, 0))
    place = n - 1 - np.arange(k)
    margin = np.finfo(float).eps * n * (np.abs(diagonal) + around).max()
    low, high = np.full(k, (diagonal - around).min() - margin), np.full(k, (diagonal + around).max() + margin)
    while True:
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            return middle
        below = sturm_counts(diagonal, off, middle) <= place
        low, high = np.where(below, middle, low), np.where(below, high, middle)


def _solver(diagonal: np.ndarray, off: np.ndarray, value: float, least: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - value) y = x by elimination with row exchanges; pivots of less than ``least`` are replaced."""
    n = len(diagonal)
    d = (diagonal - value).tolist()
    up, up2, low = [*off.tolist(), 0.0], [0.0] * n, off.tolist()
    factors, swapped = [0.0] * n, [False] * n
    for i in range(n - 1):
        if abs(low[i]) > abs(d[i]):
            swapped[i] = True
            factor = d[i] / low[i]
            d[i], up[i], up2[i], d[i + 1], up[i + 1] = low[i], d[i + 1], up[i + 1], up[i] - factor * d[i + 1], -factor * up[i + 1]
        else:
            if abs(d[i]) < least:
                d[i] = least
            factor = low[i] / d[i]
            d[i + 1] -= factor * up[i]
        factors[i] = factor
    if abs(d[-1]) < least:
        d[-1] = least

    def solve(x: np.ndarray) -> np.ndarray:
        y = x.tolist()
        for i in range(n - 1):
            if swapped[i]:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= factors[i] * y[i]
        for i in range(n - 1, -1, -1):
            rest = y[i]
            if i + 1 < n:
                rest -= up[i] * y[i + 1]
            if i + 2 < n:
                rest -= up2[i] * y[i + 2]
            y[i] = rest / d[i]
        return np.array(y)

    return solve


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, as columns, for falling eigenvalues, by inverse iteration."""
    n, eps = len(diagonal), np.finfo(float).eps
    norm = max((np.abs(diagonal) + np.abs(np.append(off, 0)) + np.abs(np.insert(off, 0, 0))).max(), 1e-200)
    rng, out, first, last = np.random.default_rng(1), np.empty((n, len(values))), 0, np.inf
    for k, value in enumerate(values.tolist()):
        if k and values[k - 1] - value > _CLOSE * norm:
            first = k  # of the cluster
        last = min(value, last - 10 * eps * norm) if k > first else value  # equal ones are parted a little
        solve = _solver(diagonal, off, last, eps * norm)
        y = rng.standard_normal(n)
        for _ in range(5):
            y = solve(y / np.abs(y).max())
            y /= np.abs(y).max()
            for _ in range(2):  # twice is enough
                y -= out[:, first:k] @ (out[:, first:k].T @ y)
            y /= np.linalg.norm(y)
        out[:, k] = y
    return out


def components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, the largest entry of each positive."""
    diagonal, off, mirrors = tridiagonal(covariance)
    values = leading(diagonal, off, k)
    vectors = eigenvectors(diagonal, off, values)
    for at in range(len(mirrors) - 1, -1, -1):
        v = mirrors[at]
        vectors[at + 1 :] -= 2 * np.outer(v, v @ vectors[at + 1 :])
    vectors /= np.linalg.norm(vectors, axis=0)
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])


@dataclass
class Fit:
    """What was learnt from all n vectors: exact sums, eigenvalues, components as columns, the covariance's trace, and the identity error."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    largest: int  # absolute entry
    identity_error: float = 0.0


def whole_numbers(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """id__ and x__: the vectors that have finite entries alone, in whole numbers."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return rows.where(v.isNotNull() & fine).select(F.col(id_col).alias("id__"), F.transform(v, lambda c: F.floor(scale * c.cast("double")) + shift).alias("x__"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _counted(x: DataFrame) -> tuple[int, np.ndarray, int]:
    """How many vectors, their sums, and their largest absolute entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            cells, value, least, most = [-1], [len(sizes)], [int(sizes.min())], [int(sizes.max())]
            if least == most and most[0]:
                rows = _matrix(batch.column(0))
                low, high = rows.min(0), rows.max(0)
                if max(-int(low.min()), int(high.max())) * len(rows) >= 1 << 63:
                    raise OverflowError("sums of entries don't fit a long")
                cells += range(rows.shape[1])
                value, least, most = value + rows.sum(0).tolist(), least + low.tolist(), most + high.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), *(pa.array(c, pa.int64()) for c in (value, least, most))], names=["cell", "value", "least", "most"])

    parts = x.select("x__").mapInArrow(run, "cell int, value long, least long, most long")
    found = {r.cell: r for r in parts.groupBy("cell").agg(F.sum("value").alias("value"), F.min("least").alias("least"), F.max("most").alias("most")).collect()}
    if not found:
        return 0, np.empty(0, np.int64), 0
    head = found.pop(-1)
    if head.least != head.most:
        raise ValueError(f"vectors have from {head.least} to {head.most} entries")
    largest = max((max(-r.least, r.most) for r in found.values()), default=0)
    if head.value * (largest + 1) * 2 >= 1 << 63:
        raise OverflowError("deviations of entries don't fit a long")
    return head.value, np.array([found[i].value for i in range(len(found))], np.int64), largest


def _products(x: DataFrame, make: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sums of products of the columns that ``make`` gives for a batch's rows, and in one more row the columns' sums."""
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, line, any_ = np.zeros((size, size)), np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                rows = make(_matrix(batch.column(0)))
                square += rows.T @ rows
                line += rows.sum(0)
                any_ = True
        if any_:
            values = np.concatenate((square[upper], line))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["cell", "value"])

    summed = x.select("x__").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    values = np.zeros(len(upper[0]) + size)
    values[summed.column("cell").to_numpy()] = summed.column("value").to_numpy()
    out = np.zeros((size + 1, size))
    out[upper] = values[: len(upper[0])]
    out[upper[::-1]] = values[: len(upper[0])]
    out[size] = values[len(upper[0]) :]
    return out


def fit(x: DataFrame, count: int = 32) -> Fit:
    """Learns from all vectors of whole_numbers()."""
    n, sums, largest = _counted(x)
    d = len(sums)
    if not n or not d:
        return Fit(n, sums, np.empty(0), np.empty((d, 0)), 0.0, largest)
    covariance = _products(x, lambda rows: (n * rows - sums) / n, d)[:d] / n
    trace = float(np.trace(covariance))
    values, vectors = components(covariance, min(count, d))
    some = int((values > _LEAST * trace).sum()) if trace > 0 else 0
    found = Fit(n, sums, values[:some], vectors[:, :some], trace, largest)
    if some:
        matrix = found.vectors / np.sqrt(found.values)
        made = _products(x, lambda rows: (n * rows - sums) / n @ matrix, some)
        mean = made[some] / n  # zero but for rounding: rows are centred before they are multiplied
        found.identity_error = float(np.abs(made[:some] / n - np.outer(mean, mean) - np.eye(some)).max())
    return found


def apply(x: DataFrame, f: Fit) -> DataFrame:
    """id__, deviation (squared distance from the mean times n squared) and ``whitened``, an array, of every vector."""
    shared = x.sparkSession.sparkContext.broadcast((f.sums, f.vectors / np.sqrt(f.values)))
    schema = StructType([x.schema["id__"], *StructType.fromDDL("deviation long, whitened array<double>").fields])
    n = f.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, matrix = shared.value
        for batch in batches:
            away = n * _matrix(batch.column(1)) - sums if batch.num_rows else np.empty((0, len(sums)), np.int64)
            far = (away.astype(np.float64) ** 2).sum(1)
            deviation = pa.array((away**2).sum(1))
            if far.max(initial=0) > 1 << 62:
                exact = [sum(v * v for v in row.tolist()) for row in away]
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            white = away / n @ matrix
            lists = pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, pa.ListArray.from_arrays(lists, pa.array(white.ravel()))], names=schema.names)

    return x.mapInArrow(run, schema)


def whiten(rows: DataFrame, count: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    x = whole_numbers(rows, id_col, vector_col)
    f = fit(x, count)
    explained = F.array(*map(F.lit, (f.values / f.trace).tolist())) if len(f.values) else F.array(F.lit(None).cast("double"))
    made = apply(x, f).select(F.col("id__").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at__", "whitened"))
    return made.select(
        "vec_id", (F.col("at__") + 1).alias("component"), F.lit(f.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at__")).alias("explained"), F.lit(f.identity_error).alias("identity_error"),
    )
