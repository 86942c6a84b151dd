"""Guarded arithmetic, target transforms and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.joins import join_many_to_one
from plumbline.operators.ordering import quantile_table

EPS = 1e-12


def finite(col: Column) -> Column:
    """NaN and infinities become null: a missing value is always NULL here."""
    value = col.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def positive(col: Column) -> Column:
    value = finite(col)
    return F.when(value > 0, value)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null unless top is finite and bottom finite and positive."""
    return finite(top) / positive(bottom)


def relative_error(observed: Column, expected: Column, floor: float = EPS) -> Column:
    return F.abs(observed - expected) / F.greatest(F.abs(observed), F.abs(expected), F.lit(floor))


def transform_target(y: Column, transform: str = "raw", unit: Column | None = None) -> Column:
    """Training target: divided by ``unit`` first (per-unit or fraction strategy), then transformed."""
    value = y if unit is None else F.try_divide(y, unit)
    if transform == "raw":
        return value
    if transform == "log1p":
        negative = F.raise_error(F.concat(F.lit("negative target under log1p: "), value.cast("string")))
        return F.when(value < 0, negative.cast("double")).otherwise(F.log1p(value))
    raise ValueError(f"unknown transform: {transform}")


def restore_target(pred: Column, transform: str = "raw", unit: Column | None = None) -> Column:
    """Prediction back in original units; a log-scale prediction is clamped at zero."""
    if transform == "log1p":
        pred = F.greatest(F.expm1(pred), F.lit(0.0))
    elif transform != "raw":
        raise ValueError(f"unknown transform: {transform}")
    return pred if unit is None else pred * unit


def high_value_weights(df: DataFrame, y: str, by: Sequence[str] = (), name: str = "weight",
                       low: float = 0.5, high: float = 2.0) -> DataFrame:
    """clip(sqrt(y / median), low, high), the median taken inside each training partition ``by``."""
    medians = quantile_table(df, [y], [0.5], by).select(*by, F.col("q")[0].alias("_median"))
    if by:
        joined = join_many_to_one(df, medians, list(by), "inner", null_safe=True)
    else:
        joined = df.withColumn("_median", medians.select("_median").scalar())
    ratio = F.sqrt(F.col(y) / F.col("_median"))
    weight = F.when(F.col("_median") > 0, F.least(F.greatest(ratio, F.lit(low)), F.lit(high)))
    return joined.withColumn(name, weight).drop("_median")
