"""Whitening of embeddings: leading eigenvectors of their covariance, found without a library's eigensolver.

Entries become whole numbers first, so sums are exact.  Tasks centre their vectors and add up one d x d matrix each; Spark adds the
matrices cell by cell.  What is left depends on the dimension alone: Householder reflections make the matrix tridiagonal, Sturm counts bisect the
leading eigenvalues, inverse iteration finds their vectors, kept apart from each other inside clusters of near eigenvalues.  The
components are broadcast and every vector is projected where it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import free, stored, with_columns

STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: larger entries are held at these ends, so that differences and sums of halves stay within 64 bits
EDGE = float(1 << 61)
#: eigenvalues under this share of the trace are rounding, not variance
RANK = 1e-12
#: eigenvalues nearer than this share of the norm form a cluster
NEAR = 1e-3
#: d x d cells in the driver and in each task
MOST_DIMENSIONS = 8192
_EPS = np.finfo(float).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal and off-diagonal of Q'aQ for symmetric ``a``, and the unit vectors of the reflections that make up Q."""
    a = np.array(a, float)
    n, reflections = len(a), []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        if not x[1:].any():
            reflections.append(None)
            continue
        length = float(np.copysign(np.linalg.norm(x / np.abs(x).max()) * np.abs(x).max(), x[0]))
        v = x.copy()
        v[0] += length
        v /= np.linalg.norm(v)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = -length
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def reflect_back(y: np.ndarray, reflections: list[np.ndarray | None]) -> np.ndarray:
    """Q times the columns of ``y``."""
    y = y.copy()
    for k in reversed(range(len(reflections))):
        v = reflections[k]
        if v is not None:
            y[k + 1:] -= 2 * np.outer(v, v @ y[k + 1:])
    return y


def count_below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray, tiny: float) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each of ``x``: negative pivots of its Sturm sequence."""
    square = off * off
    pivot = diagonal[0] - x
    count = (pivot < 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[i] - x - square[i - 1] / pivot
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, all bisected side by side."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    norm = float((np.abs(diagonal) + reach).max())
    tiny = max(_EPS * _EPS * norm, np.finfo(float).tiny)
    low, high = np.full(k, -norm * (1 + 4 * _EPS) - tiny), np.full(k, norm * (1 + 4 * _EPS) + tiny)
    wanted = n - 1 - np.arange(k)
    for _ in range(2000):
        middle = (low + high) / 2
        open_ = (high - low > 2 * _EPS * np.maximum(np.abs(low), np.abs(high)) + _EPS * _EPS * norm) & (middle > low) & (middle < high)
        if not open_.any():
            break
        above = count_below(diagonal, off, middle, tiny) > wanted
        high, low = np.where(open_ & above, middle, high), np.where(open_ & ~above, middle, low)
    return (low + high) / 2


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float, tiny: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - shift) x = b by elimination with row exchanges, done once."""
    n = len(diagonal)
    d, u, second = (diagonal - shift).tolist(), off.tolist() + [0.0], [0.0] * n
    factor, swapped = [0.0] * n, [False] * n
    for i in range(n - 1):
        below = float(off[i])
        if abs(d[i]) >= abs(below):
            factor[i] = below / d[i] if d[i] else 0.0
            d[i + 1] -= factor[i] * u[i]
        else:
            swapped[i] = True
            factor[i] = d[i] / below
            d[i], next_d = below, u[i]
            u[i], d[i + 1] = d[i + 1], next_d - factor[i] * d[i + 1]
            second[i], u[i + 1] = u[i + 1], -factor[i] * u[i + 1]
    d = [x if abs(x) > tiny else tiny for x in d]

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        for i in range(n - 1):
            if swapped[i]:
                x[i], x[i + 1] = x[i + 1], x[i] - factor[i] * x[i + 1]
            else:
                x[i + 1] -= factor[i] * x[i]
        for i in reversed(range(n)):
            t = x[i]
            if i + 1 < n:
                t -= u[i] * x[i + 1]
            if i + 2 < n:
                t -= second[i] * x[i + 2]
            x[i] = t / d[i]
        return np.array(x)
    return solve


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of the tridiagonal matrix for falling ``values``; within a cluster each is kept orthogonal to those before."""
    n = len(diagonal)
    norm = float(np.abs(diagonal).max() + 2 * (np.abs(off).max() if n > 1 else 0.0)) or 1.0
    out, first, shift = np.zeros((n, len(values))), 0, np.inf
    random = np.random.default_rng(5)
    for j, value in enumerate(values):
        if j and values[j - 1] - value > NEAR * norm:
            first = j
        shift = min(float(value), shift - 10 * _EPS * norm) if j > first else float(value)  # equal values get shifts apart
        solve = _solver(diagonal, off, shift, _EPS * norm)
        x = random.uniform(-1, 1, n)
        for _ in range(5):
            x /= np.abs(x).max()
            x = solve(x)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
            x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def leading_components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of a symmetric matrix; those that are only rounding are left out."""
    scale = float(np.abs(covariance).max()) if covariance.size else 0.0
    if not scale:
        return np.zeros(0), np.zeros((len(covariance), 0))
    diagonal, off, reflections = tridiagonal(covariance / scale)
    values = leading_values(diagonal, off, min(k, len(diagonal)))
    values = values[values > RANK * np.trace(covariance) / scale]
    return values * scale, reflect_back(inverse_iteration(diagonal, off, values), reflections)


@dataclass
class Whitening:
    n: int
    sums: list[int]  # per dimension, of the whole numbers
    values: np.ndarray
    components: np.ndarray  # dimensions x components
    trace: float

    def centre(self) -> tuple[int, np.ndarray, np.ndarray]:
        """``n``, the whole parts of the means, and the sums of what they leave, 0 to n - 1."""
        return self.n, np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64)


def centred(x: np.ndarray, centre: tuple[int, np.ndarray, np.ndarray]) -> np.ndarray:
    """``x`` less the means; the whole parts go first, so nothing is rounded away."""
    n, base, rest = centre
    return (x - base) - rest / n


def deviations(x: np.ndarray, centre: tuple[int, np.ndarray, np.ndarray]) -> list[int | None]:
    """Sum over dimensions of (n x - sum)^2, exact; None where it does not fit in 64 bits."""
    n, base, rest = centre
    y = x - base
    reach = (int(np.abs(y).max(initial=0)) + 1) * n
    if y.shape[1] * reach * reach < 1 << 63:
        t = n * y - rest
        return (t * t).sum(axis=1).tolist()
    t = n * y.astype(object) - rest.astype(object)
    return [v if v < 1 << 63 else None for v in (t * t).sum(axis=1).tolist()]


def whole_numbers(column: pa.ListArray, d: int) -> np.ndarray:
    """Rows x ``d`` entries as floor(STEPS * c) + OFFSET."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return np.floor(np.clip(flat * STEPS, -EDGE, EDGE)).astype(np.int64).reshape(-1, d) + OFFSET


def usable(vector: Column) -> Column:
    """Not null, not empty, no null and no non-finite entry."""
    def fine(v: Column) -> Column:
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine)


def _vectors(df: DataFrame, vector: str) -> Column:
    return F.col(vector).cast("array<double>")


def _sums(df: DataFrame, vector: str) -> tuple[int, list[int]]:
    """Number of vectors of the commonest length (the longer of equals) and the exact sums of their dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch.column(0)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                x = whole_numbers(column.filter(pa.array(sizes == d)), d)
                total = found.setdefault(d, np.zeros((d + 1, 2), np.int64))
                total[0, 0] += len(x)
                total[1:, 0] += (x >> 31).sum(axis=0)
                total[1:, 1] += (x & 0x7FFFFFFF).sum(axis=0)
        for d, total in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, d)), pa.array(np.arange(d + 1)), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["d", "i", "high", "low"])

    parts = df.select(_vectors(df, vector).alias("x")).where(usable(F.col("x"))).mapInArrow(run, "d long, i long, high long, low long")
    sums = stored(parts.groupBy("d", "i").agg(F.sum("high").alias("high"), F.sum("low").alias("low")))
    top = sums.where("i = 0").orderBy(F.col("high").desc(), F.col("d").desc()).first()
    if top is None:
        return 0, []
    if top["d"] > MOST_DIMENSIONS:
        raise ValueError(f"more than {MOST_DIMENSIONS} dimensions")
    rows = sorted(sums.where((F.col("d") == top["d"]) & (F.col("i") > 0)).collect(), key=lambda r: r["i"])
    return top["high"], [(r["high"] << 31) + r["low"] for r in rows]


def centred_products(df: DataFrame, column: Column, d: int, n: int, to_rows: Callable[[pa.ListArray], np.ndarray]) -> np.ndarray:
    """Covariance (divisor ``n``) of list ``column``, whose lists ``to_rows`` turns into centred rows of ``d``."""
    row, col = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            z = to_rows(batch.column(0))
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(row * d + col), pa.array(total[row, col])], names=["cell", "v"])

    cells = df.select(column.alias("x")).mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(d * d)
    out[cells["cell"].to_numpy(np.int64)] = cells["v"] / n
    out = out.reshape(d, d)
    return np.triu(out) + np.triu(out, 1).T


def _fit_list(df: DataFrame, vector: str, d: int) -> DataFrame:
    x = _vectors(df, vector)
    return df.where(usable(x) & (F.size(x) == d))


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Mean, covariance and leading components of all usable vectors of the commonest length."""
    n, sums = _sums(df, vector)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    d, model = len(sums), Whitening(n, sums, np.zeros(0), np.zeros((len(sums), 0)), 0.0)
    shared = df.sparkSession.sparkContext.broadcast(model.centre())
    covariance = centred_products(_fit_list(df, vector, d), _vectors(df, vector), d, n, lambda c: centred(whole_numbers(c, d), shared.value))
    values, found = leading_components(covariance, components)
    return Whitening(n, sums, values, found, float(np.trace(covariance)))


def project(df: DataFrame, model: Whitening, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all but the vector) of the usable rows with ``deviation`` and the array ``whitened``."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("deviation", "whitened", vector)]
    d, own = len(model.sums), free(df, "vector")
    shared = df.sparkSession.sparkContext.broadcast((model.centre(), model.components / np.sqrt(model.values)))  # dimensions x components doubles

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        centre, scaled = shared.value
        x = whole_numbers(batch.column(batch.num_columns - 1), d)
        w = centred(x, centre) @ scaled
        return {"deviation": pa.array(deviations(x, centre), pa.int64()),
                "whitened": pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, max(1, w.shape[1]), dtype=np.int32)), pa.array(w.ravel()))}

    rows = _fit_list(df, vector, d).withColumn(own, _vectors(df, vector))
    return with_columns(rows, {"deviation": T.LongType(), "whitened": T.ArrayType(T.DoubleType())}, run, keep, [own])


def identity_error(projected: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the ``whitened`` arrays minus the identity."""
    k = len(model.values)
    mean = np.array(projected.agg(F.array(*[F.avg(F.col("whitened")[i]) for i in range(k)])).first()[0])
    covariance = centred_products(projected, F.col("whitened"), k, model.n, lambda c: c.flatten().to_numpy(zero_copy_only=False).reshape(-1, k) - mean)
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, keep: list[str] | None = None) -> DataFrame:
    """Per usable row and component: ``keep`` columns, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Vectors that are null, empty, or hold null or non-finite entries are dropped, and so are those whose length is not the commonest one.  Entries become
    floor(64 c) + 1000000 (beyond 2^61 held there).  ``deviation`` is null where it exceeds 64 bits.  Directions without variance are no components, so
    equal vectors, a single one or none give no rows.  Repeated rows count each.  Columns of ``df`` named like the new ones are replaced.
    """
    made = ("component", "n", "deviation", "whitened", "explained", "identity_error", vector)
    keep = [c for c in (df.columns if keep is None else keep) if c not in made]
    model = fit(df, vector, components)
    if not len(model.values):
        return df.sparkSession.createDataFrame([], T.StructType([*(df.schema[c] for c in keep), *T.StructType.fromDDL(
            "component int, n long, deviation long, whitened double, explained double, identity_error double").fields]))
    rows = stored(project(df, model, vector, keep))
    explained = F.element_at(F.array(*[F.lit(float(v) / model.trace) for v in model.values]), F.col("component"))
    return rows.select(*keep, F.lit(model.n).cast("long").alias("n"), "deviation", F.posexplode("whitened").alias("at", "value")).select(
        *keep, (F.col("at") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened")).withColumns(
        {"explained": explained, "identity_error": F.lit(identity_error(rows, model))})
