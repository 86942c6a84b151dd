"""Experiment plans: generated rows, fingerprints, resumable execution, completeness."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from plumbline.functions.keys import fingerprint
from plumbline.operators.ordering import hash_text
from plumbline.operators.sets import support
from plumbline.sources.readers import path_exists
from plumbline.sources.writers import write_partitions


def strategy_plan(shortlist: DataFrame, algorithm: str, huber_algorithms: Sequence[str]) -> DataFrame:
    """Per candidate: squared, absolute and weighted absolute loss; Huber only where the algorithm supports it."""
    # The loss strategies of the plan.
    options = F.array(*[F.struct(F.lit(o).alias("objective"), F.lit(w).alias("weighted"))
                        for o, w in (("absolute_error", False), ("squared_error", False), ("absolute_error", True), ("pseudo_huber", False))])
    rows = shortlist.select("*", F.inline(options))
    rows = rows.where((F.col("objective") != "pseudo_huber") | F.col(algorithm).isin(*huber_algorithms))
    ident = F.concat_ws("__", *[F.col(c).cast("string") for c in shortlist.columns], "objective",
                        F.when(F.col("weighted"), "weighted").otherwise("unweighted"))
    return rows.withColumn("strategy_id", ident)


def sample_candidates(space: DataFrame, n: int, seed: object, budget_by: Sequence[str] = ()) -> DataFrame:
    """n seeded rows of a parameter grid (per algorithm when ``budget_by`` is given), in md5 order."""
    keys = sorted(space.columns)
    hashed = space.withColumn("_h", hash_text(seed, *keys))
    if not budget_by:
        return hashed.orderBy("_h", *keys).limit(n).drop("_h")
    from plumbline.operators.ranking import top_per_group
    return top_per_group(hashed, budget_by, ["_h", *keys], n).drop("_h", "rank")


def with_fingerprint(plan: DataFrame, inputs: Mapping[str, Column | str], name: str = "fingerprint") -> DataFrame:
    """sha256 of the plan row and of the digests of everything it depends on."""
    parts = [F.col(c).alias(c) for c in sorted(plan.columns)]
    parts += [(v if isinstance(v, Column) else F.lit(v)).alias(f"input_{k}") for k, v in sorted(inputs.items())]
    return plan.withColumn(name, fingerprint(*parts))


def completed(results: DataFrame, plan: DataFrame, ident: str = "experiment_id") -> DataFrame:
    """Plan rows whose stored result carries the current fingerprint; a stale one counts as missing."""
    stored = results.select(ident, "fingerprint").distinct()
    return plan.join(stored, [ident, "fingerprint"], "left_semi")


def pending(results: DataFrame, plan: DataFrame, ident: str = "experiment_id") -> DataFrame:
    stored = results.select(ident, "fingerprint").distinct()
    return plan.join(stored, [ident, "fingerprint"], "left_anti")


def matrix_progress(plan: DataFrame, results: DataFrame, ident: str = "experiment_id",
                    expected_rows: int | None = None) -> DataFrame:
    """Per plan row: complete, partial, stale or missing, with stored rows."""
    stored = results.groupBy(ident, F.col("fingerprint").alias("_fp")).agg(F.count("*").alias("n_rows"))
    current = stored.join(plan.select(ident, F.col("fingerprint").alias("_fp")), [ident, "_fp"], "left_semi")
    any_row = stored.groupBy(ident).agg(F.lit(True).alias("_any"))
    out = plan.join(current.select(ident, "n_rows"), ident, "left").join(any_row, ident, "left")
    n = F.coalesce(F.col("n_rows"), F.lit(0))
    partial = (n != expected_rows) if expected_rows is not None else F.lit(False)
    status = (F.when((n == 0) & F.col("_any"), "stale").when(n == 0, "missing").when(partial, "partial").otherwise("complete"))
    return out.withColumns({"n_rows": n, "status": status}).drop("_any")


def require_complete(progress: DataFrame, ident: str = "experiment_id") -> None:
    open_rows = progress.where(F.col("status") != "complete").select(ident, "status").limit(20).collect()
    if open_rows:
        raise ValueError("matrix incomplete: " + ", ".join(f"{r[0]} ({r[1]})" for r in open_rows))


def valid_checkpoint(stored: DataFrame, expected_keys: DataFrame, key: Sequence[str], fingerprint_value: str) -> DataFrame:
    """Whether a stored result has the right fingerprint and exactly the expected unique keys."""
    right = stored.agg(F.coalesce(F.every(F.col("fingerprint") == fingerprint_value), F.lit(False)).alias("f")).scalar()
    return support(stored, expected_keys, list(key)).withColumn("valid", F.col("same_support") & right)


def run_matrix(plan: DataFrame, runner: Callable[[Row], DataFrame], path: str, ident: str = "experiment_id") -> list[dict[str, str]]:
    """Run every plan row whose current result is not stored yet; results land in one partition per experiment.

    The driver holds plan rows only.  Each experiment is a distributed job that
    replaces its own partition, so a restarted matrix skips what is done and a
    failed experiment is reported without stopping the others.
    """
    spark = plan.sparkSession
    todo = plan
    if path_exists(spark, path):
        todo = pending(spark.read.parquet(path), plan, ident)
    statuses = []
    for row in todo.orderBy(ident).collect():
        try:
            result = runner(row).withColumns({ident: F.lit(row[ident]), "fingerprint": F.lit(row["fingerprint"])})
            write_partitions(result, path, [ident])
            statuses.append({ident: row[ident], "status": "complete", "error": ""})
        except Exception as error:  # recorded, as one failing cell must not end the matrix
            statuses.append({ident: row[ident], "status": "failed", "error": f"{type(error).__name__}: {error}"[:500]})
    return statuses
