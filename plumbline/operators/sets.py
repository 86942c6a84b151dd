"""Multiset and support comparisons, each in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.keys import digest_text, row_number_of_text


def _sides(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct rows with how often each side holds them; copies combine map-side."""
    left = a.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    right = b.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    return left.unionByName(right).groupBy(*cols).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))


def multiset_diff(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows only in a, only in b, and the total, with multiplicity; nulls equal."""
    sides = _sides(a, b, cols)
    only_a = F.coalesce(F.sum(F.greatest(F.col("_a") - F.col("_b"), F.lit(0))), F.lit(0))
    only_b = F.coalesce(F.sum(F.greatest(F.col("_b") - F.col("_a"), F.lit(0))), F.lit(0))
    return sides.agg(only_a.alias("only_in_a"), only_b.alias("only_in_b")).withColumn(
        "total_difference", F.col("only_in_a") + F.col("only_in_b"))


def multiset_rows(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The differing rows with their surplus (positive: more in a)."""
    return _sides(a, b, cols).where("_a <> _b").select(*cols, (F.col("_a") - F.col("_b")).alias("surplus"))


def schema_diff(a: DataFrame, b: DataFrame) -> tuple[list[str], list[str]]:
    """Column names only in a, only in b."""
    return sorted(set(a.columns) - set(b.columns)), sorted(set(b.columns) - set(a.columns))


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), dfs)


def overlap(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Number of distinct values on both sides and on one side only."""
    return _sides(a, b, cols).agg(
        F.count_if(F.expr("_a > 0 and _b > 0")).alias("n_overlap"), F.count_if(F.expr("_a > 0 and _b = 0")).alias("n_only_a"),
        F.count_if(F.expr("_a = 0 and _b > 0")).alias("n_only_b"))


def assert_disjoint(a: DataFrame, b: DataFrame, col: str | Sequence[str]) -> None:
    cols = [col] if isinstance(col, str) else list(col)
    n = overlap(a, b, cols).first()["n_overlap"]
    if n:
        raise ValueError(f"{n} values of {cols} are on both sides")


def support(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Row counts, uniqueness and key-set equality of two frames."""
    s = _sides(a, b, key)
    out = s.agg(
        F.coalesce(F.sum("_a"), F.lit(0)).alias("rows_a"), F.coalesce(F.sum("_b"), F.lit(0)).alias("rows_b"),
        F.count_if(F.expr("_a > 0 and _b = 0")).alias("n_only_a"), F.count_if(F.expr("_a = 0 and _b > 0")).alias("n_only_b"),
        F.count_if(F.expr("_a > 1 or _b > 1")).alias("n_repeated"))
    return out.withColumn("same_support", (F.col("n_only_a") + F.col("n_only_b") + F.col("n_repeated")) == 0)


def assert_same_support(a: DataFrame, b: DataFrame, key: Sequence[str]) -> None:
    row = support(a, b, list(key)).first()
    if not row["same_support"]:
        raise ValueError(f"supports differ: {row.asDict()}")


def cohort_digests(df: DataFrame, key: str, flags: Sequence[str]) -> DataFrame:
    """(flag, n_keys, digest): order-free digest of the key set each flag selects, in one pass."""
    number = row_number_of_text(digest_text(df.schema, [key]))
    aggs = [x for i, f in enumerate(flags) for x in (
        F.count_if(F.col(f)).alias(f"_n{i}"), F.coalesce(F.sum(F.when(F.col(f), number)), F.lit(0)).cast("string").alias(f"_d{i}"))]
    packed = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f"_n{i}").alias("n_keys"), F.col(f"_d{i}").alias("digest"))
                       for i, f in enumerate(flags)])
    return df.agg(*aggs).select(F.inline(packed))


def dedupe_cohorts(df: DataFrame, key: str, flags: Sequence[str]) -> DataFrame:
    """Flags with identical key sets share one cohort, named by the first flag."""
    digests = cohort_digests(df, key, flags)
    first = digests.groupBy("n_keys", "digest").agg(F.min("flag").alias("cohort"), F.count("*").alias("n_flags"))
    return digests.join(F.broadcast(first), ["n_keys", "digest"]).select("flag", "cohort", "n_keys", "n_flags")
