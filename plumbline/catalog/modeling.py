"""Distributed fits over the run table.  Candidate grids and tree counts are small; every row takes part."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from plumbline.catalog import base as B
from plumbline.catalog.evaluation import M_DIGITS, METRICS
from plumbline.catalog.registry import query, rounded, rsql, table
from plumbline.operators import gates as G
from plumbline.operators.evaluation import regression_metrics
from plumbline.operators.joins import attach_folds, join_many_to_one
from plumbline.operators.splits import group_folds, leave_group_out, leave_group_within
from plumbline.plans import models as P
from plumbline.plans.bundles import resolve_bundles
from plumbline.session import cut_lineage, table_path

SPEC = P.Spec(numeric=["qty", "avg_discount", "units"], categorical=["task", "hw"], target="y", unit="units")
K = 5


def model_rows(spark, d):
    """Run table with group folds and the customer's segment as family."""
    runs = B.runs(spark, d)
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("model"), F.col("c_mktsegment").alias("family"))
    models = table(spark, d, "orders").select(F.col("o_custkey").alias("model"))
    return cut_lineage(attach_folds(join_many_to_one(runs, customer, "model"), group_folds(models, "model", K, B.SEED), "model"))


def scored(df, *by):
    return rounded(regression_metrics(df, "y", "prediction", list(by)), 6, **M_DIGITS)


@query("pca_variance")
def pca_variance(spark, d):
    return rounded(P.pca_variance(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("oof_linear")
def oof_linear(spark, d):
    return scored(P.oof_linear(model_rows(spark, d), "fold", SPEC, 1.0))


@query("oof_elastic_net")
def oof_elastic_net(spark, d):
    return scored(P.oof_linear(model_rows(spark, d), "fold", SPEC, 0.1, 0.5))


@query("oof_forest")
def oof_forest(spark, d):
    return scored(P.oof_forest(model_rows(spark, d), "fold", SPEC, numTrees=200, maxDepth=4))


@query("oof_gbt")
def oof_gbt(spark, d):
    return scored(P.oof_gbt(model_rows(spark, d), "fold", SPEC, "absolute", maxIter=200, maxDepth=3))


# ---- one feature: the fits of a line have a closed form that SQL can say -----------------------

LINE = P.Spec(numeric=["units"], categorical=[], target="y")


def _line_sql(held_out: str, weight: str) -> str:
    """Rows predicted by the line through all rows with another ``held_out``; ``weight`` is its slope on the scaled feature, from n and the correlation sum c."""
    return f"""WITH {B.RUNS_SQL}, {B.folds_sql(k=K)}, t AS (SELECT runs.*, fold FROM runs JOIN folds USING (model)),
s AS (SELECT {held_out}, count(*) AS n, sum(units) AS x, sum(y) AS y, sum(units * units) AS xx, sum(units * y) AS xy FROM t GROUP BY 1),
r AS (SELECT a.{held_out}, sum(b.n) AS n, sum(b.x) / sum(b.n) AS mx, sum(b.y) / sum(b.n) AS my, sqrt(sum(b.xx) / sum(b.n) - (sum(b.x) / sum(b.n)) ** 2) AS sd, sum(b.xy) / sum(b.n) - sum(b.x) * sum(b.y) / sum(b.n) / sum(b.n) AS cov
  FROM s a JOIN s b ON a.{held_out} <> b.{held_out} GROUP BY 1),
w AS (SELECT {held_out}, mx, my, sd, {weight} AS slope FROM (SELECT *, cov / sd AS c FROM r)),
p AS (SELECT t.*, my + slope * (units - mx) / sd AS prediction, my + slope * (units - mx) / sd - y AS residual FROM t JOIN w USING ({held_out}))"""


RIDGE_SLOPE, NET_SLOPE = "n * c / (n + 50.0)", "sign(c) * greatest(abs(c) - 200.0 * 0.5, 0) / (1 + 200.0 * 0.5)"


@query("oof_ridge_line", rsql(f"{_line_sql('fold', RIDGE_SLOPE)} SELECT fold, {METRICS} FROM p GROUP BY 1", "fold, n_rows", **M_DIGITS))
def oof_ridge_line(spark, d):
    return scored(P.oof_linear(model_rows(spark, d), "fold", LINE, 50.0), "fold")


@query("oof_elastic_net_line", rsql(f"{_line_sql('fold', NET_SLOPE)} SELECT fold, {METRICS} FROM p GROUP BY 1", "fold, n_rows", **M_DIGITS))
def oof_elastic_net_line(spark, d):
    return scored(P.oof_linear(model_rows(spark, d), "fold", LINE, 200.0, 0.5), "fold")


@query("stress_line", rsql(f"{_line_sql('hw', RIDGE_SLOPE)} SELECT 'leave_hw_out' AS scheme, true AS post_hoc, hw, {METRICS} FROM p GROUP BY hw", "scheme, post_hoc, hw, n_rows", **M_DIGITS))
def stress_line(spark, d):
    rows = model_rows(spark, d).drop("fold")
    out = P.stress(rows, leave_group_out(rows, "hw"), ["hw"], replace(LINE, algorithm="ridge"), {"alpha": 50.0}, "leave_hw_out")
    return scored(out, "scheme", "post_hoc", "hw")


def _turn_sql(k: int, source: str) -> str:
    """One round of the keyed permutation over ``source`` (i, rep, l, r, rows, width, n)."""
    half, own, size = ("l", "r", "rows") if k % 2 == 0 else ("r", "l", "width")
    return f"SELECT * REPLACE (({half} + ('0x' || substr(md5('42|' || rep::VARCHAR || '|{half}|{k}|' || {own}::VARCHAR), 1, 8))::BIGINT % {size}) % {size} AS {half}) FROM ({source})"


def _once_sql(source: str) -> str:
    """All rounds from position x on."""
    inner = f"SELECT i, rep, x // width AS l, x % width AS r, rows, width, n FROM ({source})"
    for k in range(6):
        inner = _turn_sql(k, inner)
    return f"SELECT i, rep, l * width + r AS x, rows, width, n FROM ({inner})"


_LINE_ALL = f"""WITH RECURSIVE {B.RUNS_SQL}, w AS (SELECT avg(units) AS mx, avg(y) AS my, stddev_pop(units) AS sd, count(*) * covar_pop(units, y) / stddev_pop(units) / (count(*) + 50.0) AS slope FROM runs),
ix AS MATERIALIZED (SELECT units, y, row_number() OVER (ORDER BY md5('42|' || run_key::VARCHAR), run_key) - 1 AS i FROM runs),
dims AS (SELECT n, rows, (n + rows - 1) // rows AS width FROM (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS rows FROM runs)),
walk AS ({_once_sql("SELECT i, rep, i AS x, rows, width, n FROM ix, dims, range(10) reps(rep)")} UNION ALL {_once_sql("SELECT * FROM walk WHERE x >= n")}),
e AS (SELECT rep, avg(abs(my + slope * (b.units - mx) / sd - a.y)) AS mae FROM walk JOIN ix a USING (i) JOIN ix b ON b.i = walk.x, w WHERE walk.x < walk.n GROUP BY 1),
ref AS (SELECT avg(abs(my + slope * (units - mx) / sd - y)) AS mae FROM runs, w)"""


@query("importance_line", rsql(f"{_LINE_ALL} SELECT 'units' AS feature, avg(e.mae - ref.mae) AS importance_mean, stddev_samp(e.mae - ref.mae) AS importance_std, count(*) AS repeats FROM e, ref", "feature, repeats", importance_mean=3, importance_std=3))
def importance_line(spark, d):
    rows = cut_lineage(B.runs(spark, d))
    model = P.fit(rows, replace(LINE, algorithm="ridge"), {"alpha": 50.0})
    return rounded(P.permutation_importance(model, rows, ["run_key"]), 3)


GRID = [{"alpha": 0.1}, {"alpha": 100.0}]


@query("nested_cv")
def nested_cv(spark, d):
    _, meta = P.nested_cv(model_rows(spark, d), "fold", "model", SPEC, GRID)
    return meta.select("fold", "selected", "train_rows", "test_rows", "train_groups",
                       F.array_join(F.transform("scores", lambda s: F.round(s, 3).cast("string")), ";").alias("scores"))


@query("nested_cv_mean", rsql(f"WITH {B.RUNS_SQL}, {B.folds_sql(k=K)}, t AS (SELECT runs.*, fold FROM runs JOIN folds USING (model)), m AS (SELECT a.fold, avg(b.y / b.units) AS m FROM (SELECT DISTINCT fold FROM t) a JOIN t b ON a.fold <> b.fold GROUP BY 1), p AS (SELECT y, m * units AS prediction, m * units - y AS residual FROM t JOIN m USING (fold)) SELECT {METRICS} FROM p", "n_rows", **M_DIGITS))
def nested_cv_mean(spark, d):
    out, _ = P.nested_cv(model_rows(spark, d), "fold", "model", replace(SPEC, algorithm="mean"), [{}])
    return scored(out)


TARGETS = [P.Spec([], [], "y", "mean", unit, transform) for unit in (None, "units") for transform in ("raw", "log1p")]


@query("compare_targets", rsql(f"WITH {B.RUNS_SQL}, {B.folds_sql(k=K)}, t AS (SELECT runs.*, fold FROM runs JOIN folds USING (model)), m AS (SELECT a.fold, avg(b.y) AS m1, avg(ln(1 + b.y)) AS m2, avg(b.y / b.units) AS m3, avg(ln(1 + b.y / b.units)) AS m4 FROM (SELECT DISTINCT fold FROM t) a JOIN t b ON a.fold <> b.fold GROUP BY 1), "
       "l AS (SELECT y, 'direct' AS strategy, 'raw' AS transform, m1 AS prediction FROM t JOIN m USING (fold) UNION ALL SELECT y, 'direct', 'log1p', exp(m2) - 1 FROM t JOIN m USING (fold) UNION ALL SELECT y, 'per_unit', 'raw', m3 * units FROM t JOIN m USING (fold) UNION ALL SELECT y, 'per_unit', 'log1p', (exp(m4) - 1) * units FROM t JOIN m USING (fold)), "
       f"p AS (SELECT *, prediction - y AS residual FROM l) SELECT strategy, transform, {METRICS} FROM p GROUP BY ALL", "strategy, transform, n_rows", **M_DIGITS))
def compare_targets(spark, d):
    return scored(P.compare_targets(model_rows(spark, d), "fold", "model", TARGETS, [{}]), "strategy", "transform")


@query("compare_bundles")
def compare_bundles(spark, d):
    bundles = resolve_bundles({"B0": {"numeric": ["units"]}, "B1": {"base": "B0", "numeric_add": ["qty"], "categorical_add": ["task"]}})
    return rounded(P.compare_bundles(model_rows(spark, d), "model", replace(SPEC, algorithm="ridge"), bundles, {"alpha": 1.0}, K), 6, **M_DIGITS)


@query("compare_representations")
def compare_representations(spark, d):
    return scored(P.compare_representations(model_rows(spark, d), "fold", SPEC, "task", {"alpha": 1.0}), "variant")


@query("run_strategies")
def run_strategies(spark, d):
    plan = [{"objective": "squared", "weighted": False, "strategy_id": "squared"}, {"objective": "absolute", "weighted": False, "strategy_id": "absolute"},
            {"objective": "absolute", "weighted": True, "strategy_id": "absolute_weighted"}]
    spec = replace(SPEC, algorithm="boosted", unit=None)
    return scored(P.run_strategies(model_rows(spark, d), "fold", spec, plan, {"maxIter": 200, "maxDepth": 3}), "strategy_id")


@query("oof_full")
def oof_full(spark, d):
    out, folds = P.oof_full(model_rows(spark, d).drop("fold"), "model", SPEC, [{"alpha": 1.0}], K)
    return scored(out, "fold")


@query("oof_full_folds", f"WITH {B.RUNS_SQL}, {B.folds_sql(seed=42, k=K)} SELECT * FROM folds")
def oof_full_folds(spark, d):
    return group_folds(B.runs(spark, d), "model", K, SPEC.seed)


@query("fit_final")
def fit_final(spark, d):
    rows = model_rows(spark, d)
    fitted, info = P.fit_final(rows, "model", SPEC, GRID)
    path = table_path(spark)
    fitted.save(path)
    model = P.FittedModel.load(spark, path)
    return scored(model.predict(rows).withColumn("selected", F.lit(info["selected"])), "selected")


@query("importance")
def importance(spark, d):
    rows = model_rows(spark, d)
    return rounded(P.fold_importance(rows, "fold", replace(SPEC, algorithm="ridge"), {"alpha": 1.0}, ["run_key"]), 3)


@query("pdp")
def pdp(spark, d):
    rows = model_rows(spark, d)
    model = P.fit(rows, replace(SPEC, algorithm="ridge"), {"alpha": 1.0})
    return rounded(P.partial_dependence(model, rows, rows, ["qty", "avg_discount"]), 3, grid_value=6)


@query("stress")
def stress(spark, d):
    rows = model_rows(spark, d).drop("fold")
    out = P.stress(rows, leave_group_out(rows, "hw"), ["hw"], replace(SPEC, categorical=["task"]), {"alpha": 1.0}, "leave_hw_out")
    return rounded(P.stress_metrics(out, "y", "units", ["scheme", "hw"]), 6, **M_DIGITS)


@query("stress_within")
def stress_within(spark, d):
    rows = model_rows(spark, d).drop("fold").withColumn("region", F.pmod("model", F.lit(3)))
    manifest = leave_group_within(rows, "task", "region")
    spec = replace(SPEC, algorithm="mean", categorical=["hw"])
    out = P.stress(rows, manifest, ["task", "region"], spec, {}, "within_task", "task")
    return rounded(P.stress_metrics(out, "y", "units", ["scheme", "task", "region"]), 6, **M_DIGITS)


@query("ladder")
def ladder(spark, d):
    rows = model_rows(spark, d).drop("fold").withColumn("config", F.concat_ws("|", "task", "hw"))
    return rounded(P.ladder(rows, "run_key", "config", "model", "family", replace(SPEC, algorithm="ridge", categorical=[]), {"alpha": 1.0}, repeats=3, k=K), 3, r2=6)


@query("gates_nested", " UNION ALL ".join(f"SELECT 'nested:{n}' AS name, CASE WHEN count(*) FILTER ({c}) = 0 THEN 'pass' ELSE 'fail' END AS status, (count(*) FILTER ({c}))::VARCHAR AS observed, '0' AS expected FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)" for n, c in (
    ("outer_leak", "y = 1999"), ("inner_leak", "false"), ("inner_outside", "false"), ("inner_partial", "false"), ("argmin", "y % 2 = 1"))))
def gates_nested(spark, d):
    """Nested-CV metadata, one record per held-out year; 1999 leaks and odd years record a wrong choice."""
    years = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("g"))
    odd = F.element_at("g", 1)
    inner = F.transform("g", lambda v: F.struct(F.filter("g", lambda o: o != v).alias("train"), F.array(v).alias("validation")))
    meta = years.select(
        F.col("g").alias("train_groups"), F.array(F.when(F.col("y") == 1999, odd).otherwise(F.lit("held out"))).alias("test_groups"), inner.alias("inner"),
        F.array(F.lit(2.0), F.lit(None).cast("double"), F.lit(1.0)).alias("scores"), F.when(F.col("y") % 2 == 1, 0).otherwise(2).alias("selected"))
    return G.check_nested_metadata(meta)



@query("gates_nested_cv", f"""WITH {B.RUNS_SQL}, {B.folds_sql(k=K)}, n AS (SELECT (SELECT count(*) FROM folds WHERE model % 50 = 0) AS outer_leak, (SELECT count(*) FROM folds WHERE model % 60 = 2 AND fold <> 1) AS inner_leak, 1 AS inner_outside,
  (SELECT count(*) FROM folds WHERE model % 40 = 1 AND fold <> 0) AS inner_partial, (SELECT count(DISTINCT fold) FROM folds) AS argmin) """
       + " UNION ALL ".join(f"SELECT 'nested:{c}' AS name, CASE WHEN {c} = 0 THEN 'pass' ELSE 'fail' END AS status, {c}::VARCHAR AS observed, '0' AS expected FROM n" for c in ("outer_leak", "inner_leak", "inner_outside", "inner_partial", "argmin")))
def gates_nested_cv(spark, d):
    """Manifests and metadata of a real nested CV, with a fault of every kind planted: held-out groups among the inner ones, groups in two inner folds, unknown and missing ones, the other candidate."""
    rows = model_rows(spark, d)
    outer = rows.select("model", "fold").distinct()
    _, meta = P.nested_cv(rows, "fold", "model", SPEC, GRID)
    inner = P.inner_manifest(rows, "fold", "model", range(K), 3, SPEC.seed)
    leaked = outer.where("model % 50 = 0").select(F.col("fold").alias("_set"), "model", F.lit(0).alias("_inner"))
    twice = inner.where("_set = 1 AND model % 60 = 2").withColumn("_inner", F.col("_inner") + 1)
    unknown = rows.limit(1).select(F.lit(0).alias("_set"), F.lit(-1).cast("long").alias("model"), F.lit(0).alias("_inner"))
    kept = inner.where("NOT (_set = 0 AND model % 40 = 1)")
    planted = kept.unionByName(leaked).unionByName(twice).unionByName(unknown)
    return G.check_nested_rows(outer, planted, meta.withColumn("selected", 1 - F.col("selected")), "model")
