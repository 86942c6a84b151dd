"""Tables the queries share, in Spark and in SQL.

``runs`` is the run table: one row per order, with the lines of the order
aggregated before the join.  ``oof`` holds its out-of-fold mean predictions under
four target strategies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.registry import table
from plumbline.operators.joins import attach_folds, join_many_to_one
from plumbline.operators.splits import group_folds, oof_mean, oof_means
from plumbline.session import cut_lineage

SEED = 7
FOLDS = 5
# strategy -> (divide by units, transform)
STRATEGIES = {"total_raw": (None, "raw"), "total_log1p": (None, "log1p"),
              "unit_raw": ("units", "raw"), "unit_log1p": ("units", "log1p")}


def runs(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_key")).agg(
        F.count("*").alias("n_lines"), F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("avg_discount"))
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_key"), F.col("o_custkey").alias("model"), F.col("o_orderpriority").alias("task"),
        F.col("o_orderstatus").alias("hw"), F.col("o_totalprice").alias("y"), F.year("o_orderdate").cast("int").alias("year"))
    return join_many_to_one(orders, lines, "run_key").withColumn(
        "units", F.greatest(F.coalesce("n_lines", F.lit(0)), F.lit(1)).cast("bigint"))


def folds(spark: SparkSession, d: str) -> DataFrame:
    model = table(spark, d, "orders").select(F.col("o_custkey").alias("model"))
    return group_folds(model, "model", FOLDS, SEED)


def folded_runs(spark: SparkSession, d: str) -> DataFrame:
    """Run table with folds, written once: its joins and line aggregation are not repeated by later passes."""
    return cut_lineage(attach_folds(runs(spark, d), folds(spark, d), "model"))


def oof(spark: SparkSession, d: str, strategy: str = "total_raw") -> DataFrame:
    unit, transform = STRATEGIES[strategy]
    return oof_mean(folded_runs(spark, d), "y", "fold", unit, transform)


def oof_wide(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """One prediction column ``p_<strategy>`` per named strategy, over one stored run table."""
    return oof_means(folded_runs(spark, d), "y", "fold", {f"p_{n}": STRATEGIES[n] for n in names})


def oof_long(spark: SparkSession, d: str) -> DataFrame:
    """All strategies: one row per (strategy, run_key); the strategies' fold means come from one pass."""
    out = oof_wide(spark, d, *STRATEGIES)
    packed = F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(f"p_{n}").alias("prediction")) for n in STRATEGIES])
    return out.select("run_key", "model", "task", "hw", "y", "units", "fold", F.inline(packed)).withColumn(
        "residual", F.col("prediction") - F.col("y"))


RUNS_SQL = """li AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty, avg(l_discount) AS avg_discount FROM lineitem GROUP BY 1),
runs AS (SELECT o_orderkey AS run_key, o_custkey AS model, o_orderpriority AS task, o_orderstatus AS hw, o_totalprice AS y,
  year(o_orderdate)::INT AS year, n_lines, qty, avg_discount, greatest(coalesce(n_lines, 0), 1)::BIGINT AS units
  FROM orders LEFT JOIN li ON o_orderkey = l_orderkey)"""


def folds_sql(source: str = "runs", group: str = "model", seed: object = SEED, k: int = FOLDS, name: str = "folds") -> str:
    return f"""{name}_sizes AS (SELECT {group}, count(*) AS n_rows FROM {source} GROUP BY 1),
{name}_ranked AS (SELECT {group}, n_rows, row_number() OVER (ORDER BY n_rows DESC, md5('{seed}|' || {group}::VARCHAR), {group}) - 1 AS i FROM {name}_sizes),
{name} AS (SELECT {group}, n_rows, (CASE WHEN (i // {k}) % 2 = 0 THEN i % {k} ELSE {k} - 1 - i % {k} END)::INT AS fold FROM {name}_ranked)"""


FOLDED_SQL = f"""{RUNS_SQL},
{folds_sql()},
folded AS (SELECT runs.*, fold FROM runs JOIN folds USING (model))"""

OOF_SQL = f"""{FOLDED_SQL},
fold_means AS (SELECT fold,
  (sum(s1) OVER () - s1) / (sum(c) OVER () - c) AS m1, (sum(s2) OVER () - s2) / (sum(c) OVER () - c) AS m2,
  (sum(s3) OVER () - s3) / (sum(c) OVER () - c) AS m3, (sum(s4) OVER () - s4) / (sum(c) OVER () - c) AS m4
  FROM (SELECT fold, count(*) AS c, sum(y) AS s1, sum(ln(1 + y)) AS s2, sum(y / units) AS s3, sum(ln(1 + y / units)) AS s4
        FROM folded GROUP BY 1)),
oof_wide AS (SELECT run_key, model, task, hw, y, units, fold, m1 AS p1, greatest(exp(m2) - 1, 0) AS p2, m3 * units AS p3,
  greatest(exp(m4) - 1, 0) * units AS p4 FROM folded JOIN fold_means USING (fold)),
oof AS (SELECT run_key, model, task, hw, y, units, fold, strategy, prediction, prediction - y AS residual FROM (
  SELECT *, 'total_raw' AS strategy, p1 AS prediction FROM oof_wide UNION ALL SELECT *, 'total_log1p', p2 FROM oof_wide
  UNION ALL SELECT *, 'unit_raw', p3 FROM oof_wide UNION ALL SELECT *, 'unit_log1p', p4 FROM oof_wide))"""
