"""Model-evaluation queries over the out-of-fold tables."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import functions as F

from plumbline.catalog import base as B
from plumbline.catalog.joining import PAIRED_SQL, _gate_sql, paired
from plumbline.catalog.registry import query, rounded, rsql, table
from plumbline.functions import keys as K
from plumbline.functions.predicates import prediction_frame
from plumbline.operators import evaluation as E
from plumbline.operators import gates as G
from plumbline.session import cut_lineage

METRICS = """count(*) AS n_rows, avg(abs(residual)) AS mae, sqrt(avg(residual * residual)) AS rmse,
CASE WHEN var_pop(y) > 0 THEN 1 - sum(residual * residual) / (var_pop(y) * count(*)) END AS r2,
median(abs(residual) / greatest(abs(y), 1e-12) * 100) AS mdape, avg(200 * abs(residual) / greatest(abs(y) + abs(prediction), 1e-12)) AS smape, avg(residual) AS signed_bias"""
M_DIGITS = dict(mae=3, rmse=3, r2=6, mdape=4, smape=4, signed_bias=3)
UNIT = """avg(abs(residual / units)) AS per_unit_mae, sqrt(avg((residual / units) * (residual / units))) AS per_unit_rmse, avg(residual / units) AS per_unit_signed_bias, count(*) FILTER (prediction < 0) AS negative_predictions"""
U_DIGITS = dict(per_unit_mae=3, per_unit_rmse=3, per_unit_signed_bias=3)
CAL = """CASE WHEN count(y) > 1 AND var_pop(y) > 0 THEN regr_slope(prediction, y) END AS calibration_slope, CASE WHEN count(y) > 1 AND var_pop(y) > 0 THEN regr_intercept(prediction, y) END AS calibration_intercept"""
C_DIGITS = dict(calibration_slope=6, calibration_intercept=2)


@query("metrics", rsql(f"WITH {B.OOF_SQL} SELECT strategy, {METRICS} FROM oof GROUP BY 1", "strategy, n_rows", **M_DIGITS))
def metrics(spark, d):
    return rounded(E.regression_metrics(B.oof_long(spark, d), "y", "prediction", ["strategy"]), **_spec(M_DIGITS))


def _spec(digits: dict[str, int]) -> dict[str, int]:
    return {"digits": 6, **digits}


@query("metrics_overall", rsql(f"WITH {B.OOF_SQL} SELECT {METRICS} FROM oof WHERE strategy = 'total_raw'", "n_rows", **M_DIGITS))
def metrics_overall(spark, d):
    return rounded(E.regression_metrics(B.oof(spark, d), "y", "prediction"), **_spec(M_DIGITS))


@query("metrics_per_unit", rsql(f"WITH {B.OOF_SQL} SELECT strategy, count(*) AS n_rows, {UNIT} FROM oof GROUP BY 1", "strategy, n_rows, negative_predictions", **U_DIGITS))
def metrics_per_unit(spark, d):
    return rounded(E.metrics_per_unit(B.oof_long(spark, d), "y", "prediction", "units", ["strategy"]), **_spec(U_DIGITS))


@query("calibration", rsql(f"WITH {B.OOF_SQL} SELECT strategy, hw, count(*) AS n_rows, {CAL} FROM oof GROUP BY ALL", "strategy, hw, n_rows", **C_DIGITS))
def calibration(spark, d):
    return rounded(E.calibration(B.oof_long(spark, d), "y", "prediction", ["strategy", "hw"]), **_spec(C_DIGITS))


SLICES = f"""th AS (SELECT strategy, quantile_cont(y, 0.75) AS t75, quantile_cont(y, 0.9) AS t90, quantile_cont(y, 0.25) AS e1, quantile_cont(y, 0.5) AS e2, quantile_cont(y, 0.75) AS e3 FROM oof GROUP BY 1),
sl AS (SELECT *, 'overall' AS slice_type, 'all' AS slice_value FROM oof UNION ALL SELECT *, 'hw', hw FROM oof UNION ALL SELECT *, 'task', task FROM oof UNION ALL SELECT *, 'units', units::VARCHAR FROM oof
 UNION ALL SELECT oof.*, 'top25', 'tail' FROM oof JOIN th USING (strategy) WHERE y >= t75 UNION ALL SELECT oof.*, 'top10', 'tail' FROM oof JOIN th USING (strategy) WHERE y >= t90
 UNION ALL SELECT oof.*, 'target_quartile', 'Q' || (1 + (y > e1)::INT + (y > e2)::INT + (y > e3)::INT)::VARCHAR FROM oof JOIN th USING (strategy))"""


@query("error_slices", rsql(f"WITH {B.OOF_SQL}, {SLICES} SELECT strategy, slice_type, slice_value, count(DISTINCT model) AS n_clusters, median(residual) AS residual_median, {METRICS}, {UNIT}, {CAL} FROM sl GROUP BY ALL",
                            "strategy, slice_type, slice_value, n_rows, n_clusters, negative_predictions", residual_median=3, **M_DIGITS, **U_DIGITS, **{**C_DIGITS, "calibration_slope": 5, "calibration_intercept": 1}))
def error_slices(spark, d):
    out = E.error_slices(B.oof_long(spark, d), "y", "prediction", "units", "model", {"hw": "hw", "task": "task", "units": "units"}, {"top25": 0.75, "top10": 0.9}, 4, ["strategy"])
    return rounded(out, **_spec({**M_DIGITS, **U_DIGITS, "residual_median": 3, "calibration_slope": 5, "calibration_intercept": 1}))


@query("holdout_metrics", rsql(f"WITH {B.OOF_SQL}, p AS (SELECT task, arg_min(model, sha256('7|' || task || '|' || model)) AS model FROM (SELECT DISTINCT task, model FROM runs) GROUP BY 1 HAVING count(*) >= 2), h AS (SELECT * FROM oof WHERE strategy = 'unit_raw' AND model IN (SELECT model FROM p)), sl AS (SELECT *, 'overall' AS slice_type, 'all' AS slice_value FROM h UNION ALL SELECT *, 'hw', hw FROM h UNION ALL SELECT *, 'task', task FROM h) SELECT slice_type, slice_value, {METRICS} FROM sl GROUP BY ALL", "slice_type, slice_value, n_rows", **M_DIGITS))
def holdout_metrics(spark, d):
    from plumbline.operators.splits import lock_holdout
    held = cut_lineage(lock_holdout(B.oof(spark, d, "unit_raw"), "task", "model", 7)[1])
    return rounded(E.holdout_metrics(held, "y", "prediction", {"hw": "hw", "task": "task"}), **_spec(M_DIGITS))


@query("prediction_frame", rsql(f"WITH {B.OOF_SQL} SELECT run_key, model, y AS y_true, prediction AS y_pred, residual, 'mean' AS algorithm, 0::INT AS repeat FROM oof WHERE strategy = 'unit_log1p'", "run_key, model, algorithm, repeat", y_true=6, y_pred=3, residual=3))
def prediction_rows(spark, d):
    rows = B.oof(spark, d, "unit_log1p")
    return rounded(prediction_frame(rows, ["run_key", "model"], "y", F.col("prediction"), algorithm="mean", repeat=0), 3, y_true=6)


@query("validity", rsql(f"WITH {B.OOF_SQL} SELECT strategy, count(*) AS n_rows, 0::BIGINT AS n_nonfinite, count(*) FILTER (prediction < 0) AS n_negative, count(*) FILTER (prediction = 0) AS n_zero, min(prediction) AS min_prediction, max(prediction) AS max_prediction, count(DISTINCT run_key) AS n_unique_runs, 0.0::DOUBLE AS negative_fraction FROM oof GROUP BY 1", "strategy, n_rows, n_nonfinite, n_negative, n_zero, n_unique_runs", min_prediction=3, max_prediction=3, negative_fraction=6))
def validity(spark, d):
    return rounded(E.prediction_validity(B.oof_long(spark, d), "prediction", "run_key", ["strategy"]), 3, negative_fraction=6)


@query("cell_summary", rsql(f"WITH {B.OOF_SQL} SELECT strategy, hw, {METRICS} FROM oof GROUP BY ALL", "strategy, hw, n_rows", **M_DIGITS))
def cell_summary(spark, d):
    return rounded(E.summarise_cells(B.oof_long(spark, d), "y", "prediction", ["strategy", "hw"]), **_spec(M_DIGITS))


TAIL_SQL = f"""{B.OOF_SQL}, q AS (SELECT quantile_cont(y, 0.75) AS u, quantile_cont(y, 0.9) AS t FROM oof),
cells AS (SELECT strategy, {METRICS}, avg(abs(residual)) FILTER (y >= u) AS upper_mae, avg(residual) FILTER (y >= u) AS upper_signed_bias,
 avg(abs(residual)) FILTER (y >= t) AS top_mae, avg(residual) FILTER (y >= t) AS top_signed_bias, avg(abs(residual)) FILTER (y < u) AS lower_mae FROM oof, q GROUP BY 1)"""
T_DIGITS = dict(upper_mae=3, upper_signed_bias=3, top_mae=3, top_signed_bias=3, lower_mae=3)


def cells(spark, d):
    return E.tail_metrics(B.oof_long(spark, d), "y", "prediction", ["strategy"])


@query("tail_metrics", rsql(f"WITH {TAIL_SQL} SELECT * FROM cells", "strategy, n_rows", **M_DIGITS, **T_DIGITS))
def tail_metrics(spark, d):
    return rounded(cells(spark, d), **_spec({**M_DIGITS, **T_DIGITS}))


@query("shortlist", rsql(f"WITH {TAIL_SQL} SELECT strategy, mae, rmse FROM cells WHERE strategy <> 'total_raw' ORDER BY mae, rmse, strategy LIMIT 2", "strategy", mae=3, rmse=3))
def shortlist(spark, d):
    return rounded(E.top_candidates(cells(spark, d), 2, F.col("strategy") == "total_raw", ["strategy"]).select("strategy", "mae", "rmse"), 3)


@query("choose_final", f"""WITH {TAIL_SQL}, best AS (SELECT mae AS bm, upper_mae AS bu, upper_signed_bias AS bb FROM cells ORDER BY mae, rmse, strategy LIMIT 1),
m AS (SELECT *, mae <= 1.05 * bm AND upper_mae <= 0.95 * bu AND abs(upper_signed_bias) <= 0.8 * abs(bb) AS qualified FROM cells, best)
SELECT strategy, qualified FROM m ORDER BY qualified DESC, CASE WHEN qualified THEN upper_mae END, mae, rmse, strategy LIMIT 1""")
def choose_final(spark, d):
    return E.choose_final(cells(spark, d), ["strategy"]).select("strategy", "qualified")


@query("choose_level", rsql(f"WITH {B.OOF_SQL}, c AS (SELECT hw, strategy, avg(abs(residual)) AS mae, sqrt(avg(residual * residual)) AS rmse FROM oof GROUP BY ALL) SELECT hw, strategy, mae FROM (SELECT *, row_number() OVER (PARTITION BY hw ORDER BY mae, rmse, strategy) AS r FROM c WHERE strategy <> 'total_log1p') WHERE r = 1", "hw, strategy", mae=3))
def choose_level(spark, d):
    r = F.col("residual")
    matrix = B.oof_long(spark, d).groupBy("hw", "strategy").agg(F.avg(F.abs(r)).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"))
    matrix = matrix.withColumn("role", F.when(F.col("strategy") == "total_log1p", "post_hoc").otherwise("main"))
    return rounded(E.choose_level(matrix, "hw", ["mae", "rmse", "strategy"], "role").select("hw", "strategy", "mae"), 3)


@query("select_candidate", rsql(f"WITH {B.OOF_SQL}, e AS (SELECT hw, strategy, sum(abs(residual)) / count(*) AS score FROM oof GROUP BY ALL) SELECT hw, strategy, score FROM (SELECT *, row_number() OVER (PARTITION BY hw ORDER BY score, strategy) AS r FROM e) WHERE r = 1", "hw, strategy", score=3))
def select_candidate(spark, d):
    errors = B.oof_long(spark, d).groupBy("hw", "strategy", "fold").agg(F.sum(F.abs("residual")).alias("abs_error_sum"), F.count("*").alias("n_rows"))
    return rounded(E.select_candidate(errors, ["hw"], "strategy"), 3)


# ---- paired effects and bootstrap ------------------------------------------------------------

CLUSTERS = f"{PAIRED_SQL}, dl AS (SELECT model, abs(prediction_after - y) - abs(prediction_before - y) AS e FROM paired), cl AS (SELECT model, sum(e) AS s, count(e) AS c, avg(e) AS m FROM dl GROUP BY 1)"


@query("paired_effect", rsql(f"WITH {CLUSTERS} SELECT sum(c)::BIGINT AS n_rows, count(*) AS n_clusters, sum(s) / sum(c) AS row_weighted_delta_mae, avg(m) AS equal_cluster_delta_mae FROM cl", "n_rows, n_clusters", row_weighted_delta_mae=3, equal_cluster_delta_mae=3))
def paired_effect(spark, d):
    return rounded(E.paired_effect(paired(spark, d), "y", "prediction_before", "prediction_after", "model"), 3)


DRAWS, BOOT_SEED, BOOT_LEAF = 2000, 13, 256


def _mix_sql(source: str, x: str, out: str) -> str:
    """``source`` with ``out``: the 32-bit hash of ``x``."""
    return (f"SELECT * EXCLUDE (m1, m2), xor(m2, m2 >> 16) AS {out} FROM (SELECT *, (xor(m1, m1 >> 16) * 73244475) & 4294967295 AS m2 "
            f"FROM (SELECT *, (xor({x}, ({x}) >> 16) * 73244475) & 4294967295 AS m1 FROM ({source})))")


def picks_sql(clusters: str) -> str:
    """CTEs ``ix`` (clusters in hash order, with block and place in it) and ``picks`` (draw, block, i: one row per cluster that a draw takes)."""
    hashed = "SELECT draw, block, size, unnest(range(taken)) AS j FROM leaves"
    for x, out in ((f"({crc32(str(BOOT_SEED).encode())} + draw) & 4294967295", "h0"), ("(h0 + block) & 4294967295", "h1"), ("xor(h1, 1540483477)", "h2"),
                   ("(h1 + j) & 4294967295", "h3"), ("xor(h3, h2)", "h4"), ("(h3 + h2) & 4294967295", "h5")):
        hashed = _mix_sql(hashed, x, out)
    return f"""size AS (SELECT n, min(b) AS blocks FROM (SELECT count(*) AS n FROM {clusters}), (SELECT 1::BIGINT << i AS b FROM range(13) r(i)) WHERE b * {BOOT_LEAF} >= n OR b = 4096 GROUP BY n),
ix AS MATERIALIZED (SELECT c.* EXCLUDE (i), (i * blocks) // n AS block, i - ((i * blocks) // n * n + blocks - 1) // blocks AS i FROM (SELECT *, row_number() OVER (ORDER BY md5('{BOOT_SEED}|' || model::VARCHAR), model) - 1 AS i FROM {clusters}) c, size),
tree AS (SELECT draw, 1::BIGINT AS node, 0::BIGINT AS lo, blocks AS hi, n AS taken, n, blocks FROM size, range({DRAWS}) dr(draw)
  UNION ALL SELECT draw, 2 * node + s, CASE WHEN s = 0 THEN lo ELSE (lo + hi) // 2 END, CASE WHEN s = 0 THEN (lo + hi) // 2 ELSE hi END, CASE WHEN s = 0 THEN k ELSE taken - k END, n, blocks
  FROM (SELECT draw, node, lo, hi, taken, n, blocks, count(*) FILTER (reached < u) AS k FROM (
    SELECT *, sum(exp(lgamma(taken + 1) - lgamma(k + 1.0) - lgamma(taken - k + 1.0) + k * ln(p) + (taken - k) * ln(1 - p))) OVER (PARTITION BY draw, node ORDER BY k) AS reached FROM (
      SELECT *, (((lo + hi) // 2 * n + blocks - 1) // blocks - (lo * n + blocks - 1) // blocks)::DOUBLE / ((hi * n + blocks - 1) // blocks - (lo * n + blocks - 1) // blocks) AS p,
        ('0x' || substr(md5('{BOOT_SEED}|' || draw::VARCHAR || '|' || node::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u, unnest(range(taken + 1)) AS k FROM tree WHERE hi - lo > 1))
    GROUP BY ALL), range(2) sides(s)),
leaves AS MATERIALIZED (SELECT draw, lo AS block, taken, (hi * n + blocks - 1) // blocks - (lo * n + blocks - 1) // blocks AS size FROM tree WHERE hi - lo = 1),
picks AS MATERIALIZED (SELECT draw, block, (h4 * 1048576 + (h5 >> 12)) % size AS i FROM ({hashed}))"""


DRAW_SQL = f"""RECURSIVE {CLUSTERS}, {picks_sql('cl')},
draws AS (SELECT draw, sum(s) / sum(c) AS row_weighted_delta, avg(m) AS equal_cluster_delta FROM picks JOIN ix USING (block, i) GROUP BY 1)"""

def clusters(spark, d):
    return cut_lineage(E.cluster_sums(E.error_delta(paired(spark, d), "y", "prediction_before", "prediction_after"), "model", "error_delta"))


@query("bootstrap_draws", rsql(f"WITH {DRAW_SQL} SELECT * FROM draws", "draw", row_weighted_delta=3, equal_cluster_delta=3))
def bootstrap_draws(spark, d):
    return rounded(E.bootstrap_draws(clusters(spark, d), "model", DRAWS, BOOT_SEED, BOOT_LEAF), 3)


@query("cluster_bootstrap", rsql(f"WITH {DRAW_SQL} SELECT 'row_weighted_delta' AS \"column\", (SELECT sum(s) / sum(c) FROM cl) AS estimate, count(*) AS n_draws, quantile_cont(row_weighted_delta, 0.025) AS ci_low, quantile_cont(row_weighted_delta, 0.975) AS ci_high FROM draws UNION ALL SELECT 'equal_cluster_delta', (SELECT avg(m) FROM cl), count(*), quantile_cont(equal_cluster_delta, 0.025), quantile_cont(equal_cluster_delta, 0.975) FROM draws", '"column", n_draws', estimate=3, ci_low=3, ci_high=3))
def cluster_bootstrap(spark, d):
    return rounded(E.cluster_bootstrap(clusters(spark, d), "model", DRAWS, BOOT_SEED, BOOT_LEAF), 3)


@query("bootstrap_ci", rsql(f"WITH {DRAW_SQL} SELECT 'row_weighted_delta' AS \"column\", count(*) AS n_draws, quantile_cont(row_weighted_delta, 0.025) AS ci_low, quantile_cont(row_weighted_delta, 0.975) AS ci_high FROM draws", '"column", n_draws', ci_low=3, ci_high=3))
def bootstrap_ci(spark, d):
    draws = cut_lineage(E.bootstrap_draws(clusters(spark, d), "model", DRAWS, BOOT_SEED, BOOT_LEAF))
    return rounded(E.bootstrap_ci(draws, ["row_weighted_delta"]), 3)


BM_SQL = f"""WITH RECURSIVE {B.OOF_SQL}, one AS MATERIALIZED (SELECT * FROM oof WHERE strategy = 'unit_raw'), cl AS (SELECT DISTINCT model FROM one), {picks_sql('cl')},
mu AS (SELECT model, draw FROM picks JOIN ix USING (block, i))
SELECT draw, {METRICS} FROM mu JOIN one USING (model) GROUP BY 1"""


@query("bootstrap_metrics", rsql(BM_SQL, "draw, n_rows", **M_DIGITS))
def bootstrap_metrics(spark, d):
    rows = cut_lineage(B.oof(spark, d, "unit_raw").select("model", "y", "prediction"))
    return rounded(E.bootstrap_metrics(rows, "y", "prediction", "model", DRAWS, BOOT_SEED, leaf=BOOT_LEAF), **_spec(M_DIGITS))


TALLY = f"""{B.OOF_SQL}, w AS (SELECT run_key, hw, task, max(residual) FILTER (strategy = 'total_raw') AS a, max(residual) FILTER (strategy = 'unit_raw') AS b FROM oof GROUP BY ALL),
ef AS (SELECT hw, task, avg(abs(b) - abs(a)) AS delta, quantile_cont(abs(b) - abs(a), 0.25) AS lo, quantile_cont(abs(b) - abs(a), 0.75) AS hi FROM w GROUP BY ALL)"""


@query("effect_tally", rsql(f"WITH {TALLY} SELECT hw, count(*) AS n_effects, min(delta) AS min_delta, max(delta) AS max_delta, count(*) FILTER (hi < 0) AS n_improved, count(*) FILTER (lo > 0) AS n_worsened FROM ef GROUP BY 1", "hw, n_effects, n_improved, n_worsened", min_delta=3, max_delta=3))
def effect_tally(spark, d):
    from plumbline.operators.joins import pair_variants
    from plumbline.operators.ordering import quantile_columns
    wide = pair_variants(B.oof_long(spark, d), ["run_key", "hw", "task"], "strategy", ["total_raw", "unit_raw"], "residual")
    delta = cut_lineage(wide.select("hw", "task", (F.abs("residual_unit_raw") - F.abs("residual_total_raw")).alias("delta")))
    q = quantile_columns(delta, ["delta"], {"lo": 0.25, "hi": 0.75}, ["hw", "task"]).drop("column", "n")
    effects = delta.groupBy("hw", "task").agg(F.avg("delta").alias("delta")).join(q, ["hw", "task"])
    return rounded(E.effect_tally(effects, "delta", "lo", "hi", ["hw"]), 3)


# ---- association -----------------------------------------------------------------------------

CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def _corr_sql(names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, {'max(1.0)' if i == j else f'corr({names[i]}, {names[j]})'} AS r FROM s" for i, a in enumerate(CORR_COLS) for j, b in enumerate(CORR_COLS))


@query("corr_pearson", rsql(f"WITH s AS (SELECT * FROM lineitem) {_corr_sql(CORR_COLS)}", "x, y", r=6))
def corr_pearson(spark, d):
    return rounded(E.corr_matrix(table(spark, d, "lineitem"), CORR_COLS))


@query("corr_spearman", rsql("WITH s AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r{i}" for i, c in enumerate(CORR_COLS)) + f" FROM lineitem) {_corr_sql(['r0', 'r1', 'r2'])}", "x, y", r=6))
def corr_spearman(spark, d):
    return rounded(E.corr_matrix(table(spark, d, "lineitem"), CORR_COLS, "spearman"))


@query("association", rsql("WITH s AS (SELECT p_size AS x, p_retailprice AS y, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS rx, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS ry FROM part), a AS (SELECT count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM s) SELECT n, pearson, spearman, pearson * sqrt(n - 2) / sqrt(1 - pearson * pearson) AS pearson_t, spearman * sqrt(n - 2) / sqrt(1 - spearman * spearman) AS spearman_t FROM a", "n", pearson=6, spearman=6, pearson_t=5, spearman_t=5))
def association(spark, d):
    return rounded(E.association(table(spark, d, "part"), "p_size", "p_retailprice"), 6, pearson_t=5, spearman_t=5)


# ---- gates over evaluation tables ------------------------------------------------------------

_METRIC_NAMES = ("mae", "rmse", "r2", "mdape", "smape", "signed_bias")


@query("gates_metrics", f"WITH {B.OOF_SQL}, cells AS (SELECT DISTINCT strategy, task FROM oof), o AS (SELECT count(*) FILTER (task = '5-LOW') AS lost, count(*) FILTER (task = '1-URGENT') AS wrong FROM cells) " + _gate_sql(
    "o", [("metrics:keys", "lost", "0"), *[(f"metrics:{c}", "lost + wrong" if c == "mae" else "lost", "0") for c in _METRIC_NAMES]]))
def gates_metrics(spark, d):
    """The reported table lacks one task and has a wrong mae for another."""
    rows = B.oof_long(spark, d)
    reported = E.regression_metrics(rows, "y", "prediction", ["strategy", "task"]).where("task <> '5-LOW'").withColumn(
        "mae", F.when(F.col("task") == "1-URGENT", F.col("mae") * 1.001).otherwise(F.col("mae")))
    return G.check_metrics(rows, reported, "y", "prediction", ["strategy", "task"])


@query("gates_intervals", f"WITH {DRAW_SQL}, o AS (SELECT (quantile_cont(row_weighted_delta, 0.025) < quantile_cont(row_weighted_delta, 0.975))::INT + (quantile_cont(equal_cluster_delta, 0.025) < quantile_cont(equal_cluster_delta, 0.975))::INT AS n FROM draws) "
       + _gate_sql("o", [("interval:keys", "0 * n", "0"), ("interval:ci_low", "0 * n", "0"), ("interval:ci_high", "n", "0")]))
def gates_intervals(spark, d):
    """Reported upper ends are the lower ones: wrong wherever an interval has a width."""
    draws, kinds = cut_lineage(E.bootstrap_draws(clusters(spark, d), "model", DRAWS, BOOT_SEED, BOOT_LEAF)), ["row_weighted_delta", "equal_cluster_delta"]
    reported = E.bootstrap_ci(draws, kinds).withColumn("ci_high", F.col("ci_low"))
    return G.check_intervals(draws, reported, kinds, [], tol=1e-12)


@query("gates_coverage", f"WITH {B.FOLDED_SQL}, o AS (SELECT (SELECT count(*) FROM folded) - (SELECT count(*) FROM runs) AS a, (SELECT count(*) FROM (SELECT model FROM folded GROUP BY 1 HAVING count(DISTINCT fold) > 1)) AS b, (SELECT count(DISTINCT fold) FROM folded) AS k) " + _gate_sql("o", [("manifest:same_support", "a", "0"), ("manifest:isolated", "b", "0"), ("manifest:folds", "k", "5")]))
def gates_coverage(spark, d):
    return G.check_coverage(B.folded_runs(spark, d), B.runs(spark, d), ["run_key"], "model", "fold", 5)


@query("gates_paired_totals", _gate_sql("(SELECT DISTINCT o_orderstatus AS hw FROM orders)", [("paired_totals:keys", "0 * count(*)", "0"), ("paired_totals:n_rows", "count(*) FILTER (hw <> 'O')", "0")]))
def gates_paired_totals(spark, d):
    """The paired table has one row too many for every group but one."""
    pairs = paired(spark, d).join(B.runs(spark, d).select("run_key", "hw"), "run_key")
    effects = E.paired_effect(pairs, "y", "prediction_before", "prediction_after", "model", ["hw"])
    effects = effects.withColumn("n_rows", F.col("n_rows") + (F.col("hw") != "O").cast("int"))
    return G.check_paired_totals(effects, B.oof(spark, d), ["hw"])


@query("gates_fingerprints", _gate_sql("(SELECT count(*) FILTER (o_orderpriority = '5-LOW') AS n FROM (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders))", [("fingerprints", "n", "0")]))
def gates_fingerprints(spark, d):
    from plumbline.catalog.scalars import fingerprints
    now = fingerprints(spark, d)
    stored = now.withColumn("fingerprint", F.when(F.col("o_orderpriority") == "5-LOW", "old").otherwise(F.col("fingerprint")))
    return G.check_fingerprints(stored, now, "experiment_id")


@query("gates_interpretation", f"WITH {B.FOLDED_SQL} SELECT 'interpretation:folds' AS name, 'pass' AS status, '0' AS observed, '0' AS expected UNION ALL SELECT 'interpretation:features', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END, count(*)::VARCHAR, '0' FROM (SELECT hw FROM folded GROUP BY 1 HAVING count(DISTINCT task) <> 5)")
def gates_interpretation(spark, d):
    return G.check_interpretation(B.folded_runs(spark, d), "hw", "fold", "task", 5, 5)


def _orders_digest(price: str) -> str:
    row = f"to_json({{o_orderkey: o_orderkey::VARCHAR, o_totalprice: ({price})::VARCHAR}})::VARCHAR"
    return f"sum(('0x' || substr(md5({row}), 1, 15))::BIGINT::HUGEINT)::VARCHAR"


@query("gates_digest", f"""WITH o AS (SELECT count(*)::VARCHAR AS n, {_orders_digest('o_totalprice')} AS now, {_orders_digest("CASE WHEN o_orderkey % 100 = 0 THEN 1.5 ELSE o_totalprice END")} AS then_ FROM orders)
SELECT 'n_rows' AS name, 'pass' AS status, n AS observed, n AS expected FROM o
UNION ALL SELECT 'digest', CASE WHEN now = then_ THEN 'pass' ELSE 'fail' END, now, then_ FROM o
UNION ALL SELECT 'schema', 'pass', 'o_orderkey:bigint,o_totalprice:double', 'o_orderkey:bigint,o_totalprice:double'""")
def gates_digest(spark, d):
    """Frozen from rows of which some have another price: count and schema agree, the digest does not."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    changed = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 100 == 0, 1.5).otherwise(F.col("o_totalprice")))
    return G.check_digest(o, K.table_digest(changed).first().asDict())


@query("gates_receipt", _gate_sql("nation", [("row_count", "count(*)", "25")]) + " UNION ALL " + _gate_sql("region", [("unique:r_regionkey", "count(*) - count(DISTINCT r_regionkey)", "0")]) + " UNION ALL " + _gate_sql("orders", [("positive:o_totalprice", "count(*) FILTER (NOT coalesce(o_totalprice > 0, false))", "0")]))
def gates_receipt(spark, d):
    return G.run_checks([G.check_population(table(spark, d, "nation"), 25), G.check_unique(table(spark, d, "region"), ["r_regionkey"]), G.check_ranges(table(spark, d, "orders"), ["o_totalprice"])])
