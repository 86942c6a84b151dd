"""Projection, mapping, binning, flags and reason lists as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import finite
from plumbline.operators.ordering import scalar_quantiles


def project(df: DataFrame, mapping: Mapping[str, str], prefix: str = "") -> DataFrame:
    """Select and rename columns into one namespace block."""
    return df.select(*[F.col(src).alias(prefix + dst) for src, dst in mapping.items()])


def cols_with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def path_allowed(col: Column, prefix: str = "", basename: str | Sequence[str] | None = None,
                 deny: Sequence[str] = (), deny_suffix: Sequence[str] = ()) -> Column:
    """Normalised path starts with prefix, ends in an allowed basename, has no '..' part and no denied term."""
    path = F.lower(F.replace(col, F.lit("\\"), F.lit("/")))
    parts = F.split(path, "/")
    ok = path.startswith(prefix) & ~F.array_contains(parts, "..")
    if basename is not None:
        names = [basename] if isinstance(basename, str) else list(basename)
        ok = ok & F.element_at(parts, -1).isin(names)
    for term in deny:
        ok = ok & ~path.contains(term)
    for term in deny_suffix:
        ok = ok & ~path.endswith(term)
    return F.coalesce(ok, F.lit(False))


def map_values(col: Column, mapping: Mapping[str, object], required: bool = False) -> Column:
    """Plan-time lookup; unmapped values give null, or fail the query when ``required``."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), col)
    if not required:
        return found
    message = F.concat(F.lit("unmapped value: "), F.coalesce(col.cast("string"), F.lit("null")))
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(message))


def prefix_family(col: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Family of the first matching prefix of the text after the first '/', else that text."""
    slash = F.locate("/", col)
    name = F.when(slash > 0, F.substring(col, slash + 1, F.length(col))).otherwise(col)
    branches = [F.when(name.startswith(p), F.lit(f)) for p, f in rules]
    return F.coalesce(*branches, name) if branches else name


def bin_scale(col: Column, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins: value <= cut[i] -> labels[i], above all -> last label."""
    out = F.lit(labels[-1])
    for cut_point, label in reversed(list(zip(cuts, labels))):
        out = F.when(col <= cut_point, F.lit(label)).otherwise(out)
    return F.when(col.isNotNull(), out)


def cut(col: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-closed bins [edge, next edge); outside the edges -> null."""
    inside = [F.when((col >= F.lit(lo)) & (col < F.lit(hi)), F.lit(label))
              for lo, hi, label in zip(edges, edges[1:], labels)]
    return F.coalesce(*inside)


def fill_with_status(df: DataFrame, col: str, alt: str, status: str | None = None) -> DataFrame:
    """null <- alternate column, and a status column that says which one was used."""
    status = status or f"{col}_status"
    label = (F.when(F.col(col).isNotNull(), "observed").when(F.col(alt).isNotNull(), "filled").otherwise("missing"))
    return df.withColumn(status, label).withColumn(col, F.coalesce(F.col(col), F.col(alt)))


def structural_zero(df: DataFrame, col: str, applicable: Column) -> DataFrame:
    """Zero where the value cannot exist, with flags for 'applicable' and 'applicable but unknown'."""
    usable = F.coalesce(applicable, F.lit(False))
    return (df.withColumn(f"{col}_applicable", usable)
            .withColumn(f"{col}_unknown", usable & F.col(col).isNull())
            .withColumn(col, F.when(usable, F.col(col)).otherwise(F.lit(0))))


def amend(df: DataFrame, predicate: Column, cols: Sequence[str], value: Column) -> DataFrame:
    """Overwrite the listed columns on the rows the evidence names; every other cell is unchanged."""
    hit = F.coalesce(predicate, F.lit(False))
    return df.select(*[F.when(hit, value.cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def finite_nonneg(cols: Sequence[str]) -> Column:
    """True when every column is a finite number >= 0."""
    checks = [F.coalesce(finite(F.col(c).try_cast("double")) >= 0, F.lit(False)) for c in cols]
    return reduce(lambda a, b: a & b, checks, F.lit(True))


def all_present(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols], F.lit(True))


def eligibility(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Nested cohort flags: each flag also requires the one before it."""
    so_far = F.lit(True)
    for name, rule in rules.items():
        so_far = so_far & F.coalesce(rule, F.lit(False))
        df = df.withColumn(name, so_far)
        so_far = F.col(name)
    return df


def reasons(rules: Sequence[tuple[str, Column]], sep: str = ";") -> Column:
    """Codes of the rules that hold, in rule order and without repeats; null when none does."""
    codes = F.array(*[F.when(cond, F.lit(code)) for code, cond in rules])
    return F.nullif(F.concat_ws(sep, F.array_distinct(F.array_compact(codes))), F.lit(""))


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def above_quantile(df: DataFrame, col: str, q: float) -> DataFrame:
    """Rows at or above the whole population's exact quantile."""
    return df.where(F.col(col) >= scalar_quantiles(df, col, [q])[0])


def filter_plan(plan: DataFrame, limit: int | None = None, **allowed: Sequence[object] | None) -> DataFrame:
    """Optional IN filters per column and an optional row limit over an experiment plan."""
    for col, values in allowed.items():
        if values is not None:
            plan = plan.where(F.col(col).isin(list(values)))
    return plan.limit(limit) if limit is not None else plan


def prediction_frame(df: DataFrame, identity: Sequence[str], y: str, pred: Column, **labels: object) -> DataFrame:
    """Identity columns, target, prediction, residual = prediction - target, and literal labels."""
    return df.select(*identity, F.col(y).alias("y_true"), pred.alias("y_pred"),
                     (pred - F.col(y)).alias("residual"), *[F.lit(v).alias(k) for k, v in labels.items()])
