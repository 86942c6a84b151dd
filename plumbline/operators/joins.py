"""Joins with cardinality contracts, pairing, reconciliation and upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keys(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def unique_guard(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Rows of ``df`` keyed once each; a second row for a key fails the running query.

    The check rides on the aggregation that delivers the rows, so it costs no
    extra pass: duplicates combine map-side, also for a hot key.
    """
    rest = [x for x in df.columns if x not in keys]
    payload = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_one"))
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.any_value(payload).alias("_row"))
    message = F.concat(F.lit(f"duplicate key in {label}: "), F.to_json(F.struct(*keys)))
    checked = counted.withColumn("_n", F.when(F.col("_n") == 1, F.col("_n")).otherwise(F.raise_error(message)))
    # the filter makes the checked value needed, so the optimizer cannot prune it
    return checked.where(F.col("_n") == 1).select(*keys, *[F.col(f"_row.{x}").alias(x) for x in rest])


def join_many_to_one(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "left", null_safe: bool = False) -> DataFrame:
    """Join a fact side to a side that is unique on ``on``; each side is read once.

    Whether the right side is broadcast is decided while the query runs, from its measured size, and partitions that a hot key (null
    too) makes large are split by adaptive execution.  ``null_safe`` lets null keys match: right where the right side is an aggregate of the left.
    """
    keys = _keys(on)
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    if not null_safe:
        return left.join(right, keys, how)
    l, r = left.alias("l"), right.alias("r")
    same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    return l.join(r, same, how).select("l.*", *[F.col(f"r.{x}").alias(x) for x in right.columns if x not in keys])


def join_validated(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "left",
                   cardinality: str = "many_to_one") -> DataFrame:
    """Join that fails when the declared 'one' side repeats a key."""
    keys = _keys(on)
    if cardinality not in ("one_to_one", "many_to_one"):
        raise ValueError(f"unknown cardinality: {cardinality}")
    right = unique_guard(right, keys, "right side")
    if cardinality == "one_to_one":
        left = unique_guard(left, keys, "left side")
    return join_many_to_one(left, right, keys, how)


def only_keys(df: DataFrame, keys_df: DataFrame, on: str | Sequence[str]) -> DataFrame:
    keys = _keys(on)
    return df.join(keys_df.select(*keys).distinct(), keys, "left_semi")


def except_keys(df: DataFrame, keys_df: DataFrame, on: str | Sequence[str]) -> DataFrame:
    keys = _keys(on)
    return df.join(keys_df.select(*keys).distinct(), keys, "left_anti")


def enrich(df: DataFrame, dim: DataFrame, key: str, required: Sequence[str] = ()) -> DataFrame:
    """Dimension lookup; a key the dimension does not know fails the query."""
    marked = unique_guard(dim, [key], "dimension").withColumn("_known", F.lit(True))
    joined = join_many_to_one(df, marked, key)
    message = F.concat(F.lit(f"unmapped {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    known = F.when(F.col("_known"), F.col("_known")).otherwise(F.raise_error(message))
    return joined.where(known).drop("_known")


def pair_predictions(before: DataFrame, after: DataFrame, keys: str | Sequence[str], value: str,
                     carry: Sequence[str] = ()) -> DataFrame:
    """One row per key with ``<value>_before`` and ``<value>_after``; fails unless both sides
    hold exactly the same unique keys (and the same carried columns).

    Both sides go through one aggregation: support, uniqueness and agreement are
    checked on the row that carries the pair.
    """
    keys = _keys(keys)
    tagged = before.select(*keys, *carry, F.col(value).alias("_b"), F.lit(None).cast("double").alias("_a"),
                           F.lit(1).alias("_nb"), F.lit(0).alias("_na")).unionByName(
        after.select(*keys, *carry, F.lit(None).cast("double").alias("_b"), F.col(value).alias("_a"),
                     F.lit(0).alias("_nb"), F.lit(1).alias("_na")))
    grouped = tagged.groupBy(*keys, *carry).agg(
        F.sum("_nb").alias("_nb"), F.sum("_na").alias("_na"),
        F.max("_b").alias(f"{value}_before"), F.max("_a").alias(f"{value}_after"))
    message = F.concat(F.lit("paired comparison needs identical unique support: "), F.to_json(F.struct(*keys)))
    good = F.when((F.col("_nb") == 1) & (F.col("_na") == 1), F.lit(True)).otherwise(F.raise_error(message))
    return grouped.where(good).drop("_nb", "_na")


def paired_keys(df: DataFrame, keys: Sequence[str], attr: str, a: object, b: object) -> DataFrame:
    """Whether each key occurs with both values of ``attr`` (flags combine map-side, no sets)."""
    return df.groupBy(*keys).agg(
        F.max(F.coalesce(F.col(attr) == a, F.lit(False))).alias("has_a"),
        F.max(F.coalesce(F.col(attr) == b, F.lit(False))).alias("has_b"),
    ).withColumn("paired", F.col("has_a") & F.col("has_b"))


def paired_key_counts(df: DataFrame, keys: Sequence[str], attr: str, a: object, b: object) -> DataFrame:
    return paired_keys(df, keys, attr, a, b).agg(
        F.count_if("paired").alias("paired_keys"), F.count("*").alias("all_keys"))


def merge_prior(prior: DataFrame, updates: DataFrame, key: str, status: str, done: str = "available") -> DataFrame:
    """Keep the prior row when its status is done or no update exists; else take the update row.

    Columns only the updates have are added, null for kept rows.
    """
    fresh = unique_guard(updates, [key], "updates").withColumn("_hit", F.lit(True))
    fresh = fresh.select(key, *[F.col(x).alias(f"_u_{x}") for x in fresh.columns if x != key])
    joined = join_many_to_one(unique_guard(prior, [key], "prior"), fresh, key)
    replace = F.coalesce(F.col("_u__hit"), F.lit(False)) & ~F.coalesce(F.col(status) == done, F.lit(False))
    cols = [F.col(key)]
    for x in prior.columns:
        if x != key:
            cols.append((F.when(replace, F.col(f"_u_{x}")).otherwise(F.col(x)) if x in updates.columns
                         else F.col(x)).alias(x))
    cols += [F.when(replace, F.col(f"_u_{x}")).alias(x) for x in updates.columns if x not in prior.columns]
    return joined.select(*cols)


def reconcile(joined: DataFrame, planned: str, actual: str, completed: str, planned_count: str) -> DataFrame:
    """Scope, exactness, errors, status and reason of a planned total against an observed one."""
    p, a = F.col(planned).cast("double"), F.col(actual).cast("double")
    both = p.isNotNull() & a.isNotNull()
    complete = both & (F.col(completed) == F.col(planned_count))
    scope = (F.when(~both, "missing_value").when(complete, "all_requests_completed")
             .otherwise("incomplete_run_diagnostic"))
    exact = F.when(complete, a == p)
    out = joined.withColumns({
        "comparison_scope": scope, "exact_match": exact,
        "absolute_error": F.when(both, a - p), "relative_error": F.when(both, F.try_divide(a - p, p))})
    status = (F.when(F.col("exact_match"), "exact")
              .when(~F.col("exact_match"), "mismatch_unresolved_historical_equivalence")
              .when(F.col("comparison_scope") == "incomplete_run_diagnostic", "not_comparable_incomplete_run")
              .otherwise("not_comparable_missing_value"))
    reason = (F.when(status == "exact", F.lit(None))
              .when(status == "mismatch_unresolved_historical_equivalence", "completed result differs from the plan")
              .when(status == "not_comparable_incomplete_run", "result did not complete the full planned count")
              .otherwise("planned or result total is unavailable"))
    return out.withColumns({"reconciliation_status": status, "reconciliation_reason": reason})


def attach_folds(df: DataFrame, manifest: DataFrame, on: str | Sequence[str], fold: str = "fold") -> DataFrame:
    """Fold column from a manifest; the isolation column is kept once, a row without a fold fails."""
    keys = _keys(on)
    joined = join_many_to_one(df.drop(fold), unique_guard(manifest.select(*keys, fold), keys, "fold manifest"), keys)
    message = F.concat(F.lit("no fold for: "), F.to_json(F.struct(*keys)))
    return joined.withColumn(fold, F.when(F.col(fold).isNotNull(), F.col(fold)).otherwise(F.raise_error(message)))


def pair_variants(df: DataFrame, key: Sequence[str], variant: str, values: Sequence[str], value: str) -> DataFrame:
    """Long to wide: one column per named variant (values given, so no discovery job)."""
    return df.groupBy(*key).agg(*[F.max(F.when(F.col(variant) == v, F.col(value))).alias(f"{value}_{v}")
                                  for v in values])


def residual_features(pred: DataFrame, feats: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Residuals joined to features one to one; a prediction without features fails."""
    keys = _keys(key)
    marked = unique_guard(feats, keys, "features").withColumn("_known", F.lit(True))
    joined = join_many_to_one(pred, marked, keys)
    message = F.concat(F.lit("prediction without features: "), F.to_json(F.struct(*keys)))
    return joined.where(F.when(F.col("_known"), F.lit(True)).otherwise(F.raise_error(message))).drop("_known")


def expand_pairs(runs: DataFrame, stats: DataFrame, on: Sequence[str], repeats: str,
                 additive: Sequence[str]) -> DataFrame:
    """Statistics computed once per pair, fanned out to runs; additive ones are multiplied by repeats.  A repeated pair fails."""
    joined = join_many_to_one(runs, unique_guard(stats, list(on), "pair statistics"), on)
    return joined.withColumns({x: F.col(x) * F.col(repeats) for x in additive})


def frames_differ(a: DataFrame, b: DataFrame, key: str | Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per column: number of keys whose value differs, plus rows only on one side; null keys and values are equal to themselves.

    Both tables go through one aggregation by key, in which copies combine map-side.
    """
    keys = _keys(key)
    left = a.select(*keys, F.struct(*cols).alias("_a"), F.lit(None).cast(b.select(F.struct(*cols).alias("_b")).schema["_b"].dataType).alias("_b"))
    right = b.select(*keys, F.lit(None).cast(a.select(F.struct(*cols).alias("_a")).schema["_a"].dataType).alias("_a"), F.struct(*cols).alias("_b"))
    both = left.unionByName(right).groupBy(*keys).agg(
        F.count("_a").alias("_na"), F.count("_b").alias("_nb"), F.any_value("_a", F.lit(True)).alias("_a"), F.any_value("_b", F.lit(True)).alias("_b"))
    matched = (F.col("_na") > 0) & (F.col("_nb") > 0)
    counts = both.agg(
        F.coalesce(F.sum(F.greatest(F.col("_na") - F.col("_nb"), F.lit(0))), F.lit(0)).alias("_only_a"),
        F.coalesce(F.sum(F.greatest(F.col("_nb") - F.col("_na"), F.lit(0))), F.lit(0)).alias("_only_b"),
        *[F.count_if(matched & ~F.col(f"_a.{x}").eqNullSafe(F.col(f"_b.{x}"))).alias(f"d_{x}") for x in cols])
    rows = [F.struct(F.lit("rows only in first").alias("what"), F.col("_only_a").alias("n")),
            F.struct(F.lit("rows only in second").alias("what"), F.col("_only_b").alias("n"))]
    rows += [F.struct(F.lit(x).alias("what"), F.col(f"d_{x}").alias("n")) for x in cols]
    return counts.select(F.inline(F.array(*rows)))


def cross_plan(spark, **dims: Sequence[object]) -> DataFrame:
    """Plan rows for every combination of configuration lists (each exploded from a literal array)."""
    plan = spark.range(1).select()
    for name, values in dims.items():
        plan = plan.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return plan


def data_plan(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Every combination of the values the data holds for the dimensions, as distributed joins of their distinct values."""
    plan = None
    for d in dims:
        values = df.select(d).where(F.col(d).isNotNull()).distinct()
        plan = values if plan is None else plan.crossJoin(values)
    return plan
