"""Linear fits for every held-out part at once, from sums that add up.

Imputing, flagging, one-hot coding and scaling are linear in a few raw columns: a value or zero, whether it is missing, and one column per category.  One pass
sums the products of these columns and the target per part; what is left without a part is a subtraction, its medians come from
complement counts, and ridge or elastic net for each part and candidate is a small system solved on the driver.  Nothing is fitted row by row.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.numeric import finite, restore_target, transform_target
from plumbline.operators.ordering import quantile_table
from plumbline.operators.profile import value_counts
from plumbline.session import cut_lineage

# task code travels with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: raw columns up to which products are summed: their square is held per part
MOST_COLUMNS = 2048
#: cells of a block of rows in a task
CELLS = 1 << 20
SWEEPS, TOLERANCE = 100_000, 1e-13


def soft(x: float, by: float) -> float:
    return x - by if x > by else x + by if x < -by else 0.0


def descend(gram: np.ndarray, target: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Weights that minimise w'Gw / 2 - t'w + l1 |w|_1 + l2 |w|^2 / 2, by sweeps of soft-thresholded coordinates."""
    w, pull = np.zeros(len(target)), np.array(target, float)  # pull: t - Gw
    for _ in range(SWEEPS):
        moved = 0.0
        for j in range(len(w)):
            curve = gram[j, j] + l2
            new = soft(pull[j] + gram[j, j] * w[j], l1) / curve if curve > 0 else 0.0
            if new != w[j]:
                pull -= gram[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]) * np.sqrt(max(gram[j, j], 0.0)))
                w[j] = new
        if moved <= TOLERANCE * max(1.0, np.abs(target).max(initial=0.0)):
            break
    return w


@dataclass
class Basis:
    """Raw columns: 1, values, missing flags, categories, null flags of the categorical columns; the target last."""

    numeric: list[str]
    categorical: list[str]
    labels: list[list[str]]
    shift: list[float]  # of the numeric columns and the target: keeps the sums small

    @property
    def width(self) -> int:
        return 1 + 2 * len(self.numeric) + sum(map(len, self.labels)) + len(self.categorical)

    def first_label(self, i: int) -> int:
        return 1 + 2 * len(self.numeric) + sum(len(x) for x in self.labels[:i])

    def null_flag(self, i: int) -> int:
        return self.width - len(self.categorical) + i

    def rows(self, batch: pa.RecordBatch) -> np.ndarray:
        """Raw columns and target of a batch whose columns are the numeric, then the categorical ones, then the target."""
        n, m = batch.num_rows, len(self.numeric)
        out = np.zeros((n, self.width + 1))
        out[:, 0] = 1.0
        for j in range(m):
            missing = batch.column(j).is_null().to_numpy(zero_copy_only=False)
            value = batch.column(j).fill_null(self.shift[j]).to_numpy(zero_copy_only=False)
            out[:, 1 + j], out[:, 1 + m + j] = value - self.shift[j], missing
        for i, known in enumerate(self.labels):
            column = batch.column(m + i)
            code = pc.index_in(column, value_set=pa.array(known, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(code >= 0)
            out[at, self.first_label(i) + code[at]] = 1.0
            out[:, self.null_flag(i)] = column.is_null().to_numpy(zero_copy_only=False)
        out[:, -1] = batch.column(m + len(self.labels)).to_numpy(zero_copy_only=False) - self.shift[m]
        return out


def _upper_sums(sums: DataFrame, keys: Sequence[str], size: int) -> dict[tuple[object, ...], np.ndarray]:
    """The symmetric matrix of each key from the entries ``v`` at the places ``at`` of its upper half, added up."""
    row, col = np.triu_indices(size)
    found: dict[tuple[object, ...], np.ndarray] = {}
    for r in sums.groupBy(*keys, "at").agg(F.sum("v").alias("v")).collect():
        g = found.setdefault(tuple(r[c] for c in keys), np.zeros((size, size)))
        i, j = row[r["at"]], col[r["at"]]
        g[i, j] = g[j, i] = r["v"]
    return found


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Slices whose raw columns have at most ``CELLS`` cells."""
    step = max(1, CELLS // size)
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def _without(batch: pa.RecordBatch, first: int) -> pa.RecordBatch:
    """The columns from ``first`` on."""
    return pa.RecordBatch.from_arrays(batch.columns[first:], names=batch.schema.names[first:])


def _members(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of an integer column with the places that have it; nulls are left out."""
    code = column.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    for value in np.unique(code[code >= 0]).tolist():
        yield value, np.flatnonzero(code == value)


def product_sums(rows: DataFrame, cells: Sequence[str], basis: Basis) -> dict[tuple[object, ...], np.ndarray]:
    """Per cell the sums of products of all raw columns and the target; one aggregation, one matrix a cell on the driver."""
    size, cells = basis.width + 1, list(cells)
    row, col = np.triu_indices(size)
    out = T.StructType([*(rows.schema[c] for c in cells), T.StructField("at", T.LongType()), T.StructField("v", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[object, ...], np.ndarray] = {}
        for part in _blocks(batches, size):
            keys = list(zip(*[part.column(i).to_pylist() for i in range(len(cells))]))
            place: dict[tuple[object, ...], int] = {}
            number = np.array([place.setdefault(k, len(place)) for k in keys])
            z = basis.rows(_without(part, len(cells)))
            for key, i in place.items():
                mine = z[number == i]
                total[key] = total.get(key, 0.0) + mine.T @ mine
        for key, g in total.items():
            v = g[row, col]
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([*[pa.array([k] * len(at), type=kind) for k, kind in zip(key, kinds)], pa.array(at), pa.array(v[at])], names=[*cells, "at", "v"])

    kinds = [f.type for f in rows.select(*cells).limit(0).toArrow().schema]
    return _upper_sums(rows.select(*cells, *basis.numeric, *basis.categorical, "_y").mapInArrow(run, out), cells, size)


def part_sums(rows: DataFrame, parts: Sequence[str], basis: Basis) -> dict[tuple[int, int], np.ndarray]:
    """The same per (place in ``parts``, value of that column): every row is read once and counts in each of these columns that is not null."""
    size, parts = basis.width + 1, list(parts)
    row, col = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for part in _blocks(batches, size):
            z = basis.rows(_without(part, len(parts)))
            for i in range(len(parts)):
                for value, at in _members(part.column(i)):
                    mine = z[at]
                    total[i, value] = total.get((i, value), 0.0) + mine.T @ mine
        for (i, value), g in total.items():
            v = g[row, col]
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), pa.int64()), pa.array([value] * len(at), pa.int64()), pa.array(at), pa.array(v[at])], names=["part", "value", "at", "v"])

    return _upper_sums(rows.select(*parts, *basis.numeric, *basis.categorical, "_y").mapInArrow(run, "part long, value long, at long, v double"), ["part", "value"], size)


@dataclass
class Fits:
    """Coefficients over the raw columns, per group, left-out value and candidate."""

    basis: Basis
    keys: list[str]
    coefficients: dict[tuple[object, ...], list[np.ndarray]]

    def table(self, df: DataFrame, chosen: Mapping[tuple[object, ...], Sequence[int]] | None = None) -> DataFrame:
        """One row per key and candidate (those ``chosen`` for a key): few and narrow, so they may be broadcast."""
        b, m, rows = self.basis, len(self.basis.numeric), []
        for key, each in self.coefficients.items():
            for c in (chosen[key] if chosen else range(len(each))):
                w = each[c].tolist()
                maps = [dict(zip(known, w[b.first_label(i):])) for i, known in enumerate(b.labels)]
                rows.append((*key, c, w[0], w[1:1 + m], w[1 + m:1 + 2 * m], maps, w[b.width - len(b.categorical):]))
        fields = [T.StructField(k, df.schema[k].dataType) for k in self.keys]
        doubles = T.ArrayType(T.DoubleType())
        schema = T.StructType([*fields, T.StructField("_candidate", T.IntegerType()), T.StructField("_start", T.DoubleType()), T.StructField("_value", doubles),
                               T.StructField("_missing", doubles), T.StructField("_maps", T.ArrayType(T.MapType(T.StringType(), T.DoubleType()))), T.StructField("_null", doubles)])
        return F.broadcast(df.sparkSession.createDataFrame(rows, schema))

    def raw_prediction(self) -> Column:
        terms = [F.col("_start")]
        for j, (name, shift) in enumerate(zip(self.basis.numeric, self.basis.shift)):
            v = finite(F.col(name))
            terms.append(F.coalesce((v - shift) * F.col("_value")[j], F.col("_missing")[j]))
        for i, name in enumerate(self.basis.categorical):
            v = F.col(name).cast("string")
            terms.append(F.when(v.isNull(), F.col("_null")[i]).otherwise(F.coalesce(F.try_element_at(F.col("_maps")[i], v), F.lit(0.0))))
        return sum(terms[1:], terms[0])


def _solve(g: np.ndarray, basis: Basis, medians: Sequence[float], algorithm: str, candidates: Sequence[Mapping[str, object]]) -> list[np.ndarray]:
    """Coefficients over the raw columns for each candidate, from the sums of a training part."""
    n, m, p = g[0, 0], len(basis.numeric), basis.width
    columns, scaled = [], []
    for j in range(m):
        e = np.zeros(p)
        e[1 + j], e[1 + m + j] = 1.0, medians[j] - basis.shift[j]
        columns.append(e)
        scaled.append(True)
    for j in range(m):
        if g[0, 1 + m + j] > 0.5:
            e = np.zeros(p)
            e[1 + m + j] = 1.0
            columns.append(e)
            scaled.append(True)
    for i, known in enumerate(basis.labels):
        at = basis.first_label(i)
        counts = g[0, at:at + len(known)]
        mode = int(np.argmax(counts)) if len(known) else -1  # labels are sorted, so the first of equals by name
        for k in np.flatnonzero(counts > 0.5).tolist():
            e = np.zeros(p)
            e[at + k] = 1.0
            e[basis.null_flag(i)] = float(k == mode)
            columns.append(e)
            scaled.append(False)
    a = np.array(columns).T.reshape(p, len(columns))
    mean, target_mean = a.T @ g[:p, 0] / n, g[0, p] / n
    spread = a.T @ g[:p, :p] @ a / n - np.outer(mean, mean)
    joint = a.T @ g[:p, p] / n - mean * target_mean
    size = np.array([np.sqrt(max(spread[j, j], 0.0)) if s else 1.0 for j, s in enumerate(scaled)])
    size[size <= 1e-12 * np.maximum(1.0, np.abs(mean))] = 1.0
    spread, joint = spread / np.outer(size, size), joint / size
    out = []
    for params in candidates:
        alpha = float(params.get("alpha", 1.0))
        if algorithm == "ridge":
            w = np.linalg.lstsq(n * spread + alpha * np.eye(len(size)), n * joint, rcond=None)[0]
        else:
            ratio = float(params.get("l1_ratio", 0.5))
            w = descend(spread, joint, alpha * ratio, alpha * (1 - ratio))
        w = w / size
        raw = a @ w
        raw[0] += target_mean + basis.shift[m] - mean @ w
        out.append(raw)
    return out


def prepared(df: DataFrame, spec: object) -> DataFrame:
    """``df`` with the transformed target ``_y``, numeric columns as doubles (null where not finite), categories as text."""
    unit = F.col(spec.unit) if spec.unit else None
    rows = df.withColumn("_y", transform_target(F.col(spec.target), spec.transform, unit).cast("double"))
    return rows.withColumns({**{c: finite(F.col(c)) for c in spec.numeric}, **{c: F.col(c).cast("string") for c in spec.categorical}})


def basis_of(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Basis | None:
    """Labels and means of ``prepared`` rows; None where there are too many categories for products."""
    labels: list[list[str]] = [[] for _ in categorical]
    if categorical:
        names = value_counts(rows, categorical).where(F.col("value").isNotNull()).select("column", "value").limit(MOST_COLUMNS + 1).collect()
        if len(names) + 2 * len(numeric) + len(categorical) + 1 > MOST_COLUMNS:
            return None
        labels = [sorted(r["value"] for r in names if r["column"] == c) for c in categorical]
    means = rows.agg(F.array(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in (*numeric, "_y")])).first()[0]
    return Basis(list(numeric), list(categorical), labels, list(means))


def fit_all(df: DataFrame, by: Sequence[str], leave_out: str, spec: object, candidates: Sequence[Mapping[str, object]]) -> Fits | None:
    """Fits of all rows of each group but those of each ``leave_out`` value; None where there are too many categories for products."""
    rows = prepared(df, spec).where(F.col("_y").isNotNull()).select(*by, leave_out, *spec.numeric, *spec.categorical, "_y")
    numeric, by = list(spec.numeric), list(by)
    basis = basis_of(rows, numeric, spec.categorical)
    if basis is None:
        return None
    medians: dict[tuple[object, ...], dict[str, float]] = {}
    if numeric:
        for r in quantile_table(rows, numeric, [0.5], by, leave_out=leave_out).collect():
            medians.setdefault(tuple(r[c] for c in (*by, leave_out)), {})[r["column"]] = r["q"][0] if r["q"] else 0.0
    sums = product_sums(rows, [*by, leave_out], basis)
    totals: dict[tuple[object, ...], np.ndarray] = {}
    for key, g in sums.items():
        totals[key[:-1]] = totals.get(key[:-1], 0.0) + g
    found = {}
    for key, g in sums.items():
        rest = totals[key[:-1]] - g
        if rest[0, 0] > 0.5:
            found[key] = _solve(rest, basis, [medians.get(key, {}).get(c, 0.0) for c in numeric], spec.algorithm, candidates)
    return Fits(basis, [*by, leave_out], found)


def predict(df: DataFrame, fits: Fits, spec: object, chosen: Mapping[tuple[object, ...], Sequence[int]] | None = None, name: str = "prediction") -> DataFrame:
    """Rows of ``df`` whose key has a fit, once per (chosen) candidate ``_candidate``, with the prediction in original units."""
    table = fits.table(df, chosen)
    joined = df.join(table, fits.keys)
    unit = F.col(spec.unit) if spec.unit else None
    return joined.withColumn(name, restore_target(fits.raw_prediction(), spec.transform, unit)).select(*df.columns, "_candidate", name)


def out_of_fold(df: DataFrame, fold: str, spec: object, params: Mapping[str, object], by: Sequence[str] = ()) -> DataFrame | None:
    """Every row predicted by the fit of the others; within each group of ``by``."""
    fits = fit_all(df, by, fold, spec, [params])
    return None if fits is None else predict(df, fits, spec).drop("_candidate")


def inner_scores(df: DataFrame, parts: Sequence[str], basis: Basis, spec: object, candidates: Sequence[Mapping[str, object]]) -> dict[tuple[int, int], float]:
    """Mean absolute error by (place in ``parts``, candidate): each value of a part's column is predicted by the fit of its other rows.

    A row belongs to nearly all parts.  It is read once for the medians, once for the products and once for the errors of all of them.
    """
    unit = F.col(spec.unit) if spec.unit else F.lit(None)
    wide = prepared(df.withColumns({"_target": F.col(spec.target).cast("double"), "_unit": unit.cast("double")}), spec)
    parts, m = list(parts), len(candidates)
    rows = wide.where(F.col("_y").isNotNull()).select(*parts, *basis.numeric, *basis.categorical, "_y")
    sums = part_sums(rows, parts, basis)
    keys = sorted(sums)
    medians: dict[tuple[int, int], dict[str, float]] = {}
    if basis.numeric and keys:
        def sets(own: Sequence[Column]) -> Column:
            return F.array(*[F.struct(F.lit(n).alias("_set"), F.coalesce(own[i] != value, F.lit(False)).alias("_in")) for n, (i, value) in enumerate(keys)])
        for r in quantile_table(rows, basis.numeric, [0.5], sets=(parts, sets)).collect():
            medians.setdefault(keys[r["_set"]], {})[r["column"]] = r["q"][0] if r["q"] else 0.0
    fits: dict[tuple[int, int], np.ndarray] = {}
    for i, value in keys:
        rest = sum(g for (j, other), g in sums.items() if j == i and other != value)
        if not np.isscalar(rest) and rest[0, 0] > 0.5:
            own = medians.get((i, value), {})
            fits[i, value] = np.array(_solve(rest, basis, [own.get(c, 0.0) for c in basis.numeric], spec.algorithm, candidates)).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches, basis.width + 1):
            z = basis.rows(_without(part, len(parts) + 2))[:, :-1]
            out = np.full((part.num_rows, len(parts) * m), np.nan)
            for i in range(len(parts)):
                for value, at in _members(part.column(i)):
                    if (i, value) in fits:
                        out[at, i * m:(i + 1) * m] = z[at] @ fits[i, value]
            flat = pc.if_else(pc.is_nan(pa.array(out.ravel())), None, pa.array(out.ravel()))
            raw = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, max(1, out.shape[1])), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([part.column(len(parts)), part.column(len(parts) + 1), raw], names=["_target", "_unit", "raw"])

    raw = wide.select(*parts, "_target", "_unit", *basis.numeric, *basis.categorical, "_y")
    raw = raw.mapInArrow(run, "_target double, _unit double, raw array<double>").select("_target", "_unit", F.posexplode("raw").alias("at", "raw"))
    restored = restore_target(F.col("raw"), spec.transform, F.col("_unit") if spec.unit else None)
    errors = raw.where(F.col("raw").isNotNull()).groupBy("at").agg(F.avg(F.abs(restored - F.col("_target"))).alias("e"))
    return {divmod(r["at"], m): r["e"] for r in errors.collect()}


def nested(df: DataFrame, fold: str, inner: DataFrame | None, group: str, spec: object, candidates: Sequence[Mapping[str, object]]) -> tuple[DataFrame, dict[object, list[float | None]], dict[object, int]] | None:
    """(predictions, scores by fold, choice by fold): candidates compared on the inner folds of each outer training part.

    ``inner`` (``_set``, group, ``_inner``) gives the inner fold of every training group of every outer fold ``_set``; it is read only where there are several candidates.
    """
    outer = fit_all(df, [], fold, spec, candidates)
    if outer is None:
        return None
    scores: dict[object, list[float | None]] = {k[0]: [None] * len(candidates) for k in outer.coefficients}
    if len(candidates) > 1:
        needed = list(dict.fromkeys([group, spec.target, *([spec.unit] if spec.unit else []), *spec.numeric, *spec.categorical]))
        outside, parts = sorted(scores), [f"_in{i}" for i in range(len(scores))]
        # one row a group with its inner fold in every outer training part
        by_group = inner.groupBy(group).agg(*[F.max(F.when(F.col("_set") == k, F.col("_inner"))).alias(p) for k, p in zip(outside, parts)])
        rows = cut_lineage(df.select(*needed).join(by_group, group))
        for (i, c), e in inner_scores(rows, parts, outer.basis, spec, candidates).items():
            scores[outside[i]][c] = e
    choice = {k: min(((s, i) for i, s in enumerate(each) if s is not None), default=(None, 0))[1] for k, each in scores.items()}
    return predict(df, outer, spec, {(k,): [c] for k, c in choice.items()}), scores, choice
