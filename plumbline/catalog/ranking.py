"""Bins, ranks, picks, running totals, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import base as B
from plumbline.catalog.registry import query, rounded, rsql, table
from plumbline.functions.predicates import bin_scale
from plumbline.operators import ranking as W
from plumbline.operators import splits as T
from plumbline.plans import matrix as M

QCUT = "SELECT o_orderkey, (1 + (v > e1)::INT + (v > e2)::INT + (v > e3)::INT)::INT AS bin FROM (SELECT o_orderkey, o_totalprice AS v FROM orders), (SELECT quantile_cont(o_totalprice, 0.25) AS e1, quantile_cont(o_totalprice, 0.5) AS e2, quantile_cont(o_totalprice, 0.75) AS e3 FROM orders)"


@query("qcut", QCUT)
def qcut(spark, d):
    return W.qcut(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 4).select("o_orderkey", "bin")


@query("qcut_by_group", "SELECT o_orderkey, (1 + (o_totalprice > e1)::INT + (o_totalprice > e2)::INT)::INT AS bin FROM orders JOIN (SELECT o_orderstatus, quantile_cont(o_totalprice, 1/3) AS e1, quantile_cont(o_totalprice, 2/3) AS e2 FROM orders GROUP BY 1) USING (o_orderstatus)")
def qcut_by_group(spark, d):
    return W.qcut(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_totalprice", 3, ["o_orderstatus"]).select("o_orderkey", "bin")


@query("qcut_ties", "WITH e AS (SELECT quantile_cont(l_discount, 0.25) AS e1, quantile_cont(l_discount, 0.5) AS e2, quantile_cont(l_discount, 0.75) AS e3 FROM lineitem) SELECT l_discount, (1 + (l_discount > e1)::INT + (l_discount > e2)::INT + (l_discount > e3)::INT)::INT AS bin, count(*) AS n FROM lineitem, e GROUP BY ALL")
def qcut_ties(spark, d):
    return W.qcut(table(spark, d, "lineitem").select("l_discount"), "l_discount", 4).groupBy("l_discount", "bin").agg(F.count("*").alias("n"))


@query("first_per_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_per_group(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return W.first_per_group(o, ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"])


@query("top_per_group", "SELECT o_orderstatus, o_orderkey, o_totalprice, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 5")
def top_per_group(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    return W.top_per_group(o, ["o_orderstatus"], [F.col("o_totalprice").desc(), "o_orderkey"], 5)


@query("hash_pick", "SELECT c_nationkey, count(*) AS n_ids, arg_min(c_custkey, sha256('7|' || c_nationkey || '|' || c_custkey)) AS c_custkey FROM customer GROUP BY 1 HAVING count(*) >= 2")
def hash_pick(spark, d):
    return W.hash_pick(table(spark, d, "customer"), "c_nationkey", "c_custkey", 7)


@query("cumulative", rsql("SELECT day, n, sum(n) OVER (ORDER BY day)::BIGINT AS cumulative, sum(n) OVER (ORDER BY day) / sum(n) OVER () AS cumulative_share FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1)", "day, n, cumulative", cumulative_share=6))
def cumulative(spark, d):
    days = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return rounded(W.cumulative(days, "day", "n"))


RANK = "SELECT l_quantity, count(*) AS n, any_value(r) AS avg_rank FROM (SELECT l_quantity, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem) GROUP BY 1"


@query("value_ranks", rsql(RANK, "l_quantity, n", avg_rank=1))
def value_ranks(spark, d):
    return rounded(W.value_ranks(table(spark, d, "lineitem"), "l_quantity"), 1, l_quantity=6)


@query("avg_rank", rsql("SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1) / 2.0 AS avg_rank FROM orders", "o_orderkey", avg_rank=1))
def avg_rank(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return rounded(W.avg_rank(o, "o_totalprice", ["o_orderstatus"]).select("o_orderkey", "avg_rank"), 1)


BIAS_SQL = f"""WITH {B.OOF_SQL}, one AS (SELECT * FROM oof WHERE strategy = 'total_raw'),
e AS (SELECT quantile_cont(y, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM one),
b AS (SELECT residual, (1 + len(list_filter(q, lambda x: x < y)))::INT AS bin FROM one, e)
SELECT bin, count(*) AS n_rows, avg(residual) AS mean_residual, median(residual) AS median_residual FROM b GROUP BY 1"""


@query("bias_decile", rsql(BIAS_SQL, "bin, n_rows", mean_residual=3, median_residual=3))
def bias_decile(spark, d):
    rows = B.oof(spark, d).select("y", (F.col("prediction") - F.col("y")).alias("residual"))
    return rounded(W.bias_by_bin(rows, "y", "residual", 10), 3)


@query("ordered", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def ordered(spark, d):
    return W.ordered(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey", "o_totalprice", "o_orderkey"], ["o_totalprice"])


@query("bounded_examples", "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey LIMIT 12")
def bounded_examples(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    return W.bounded_examples(lines, ["l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey"], 12, ["l_extendedprice"])


@query("curves", rsql("SELECT o_orderstatus AS fold, row_number() OVER (PARTITION BY o_orderstatus ORDER BY x) - 1 AS position, x, y FROM (SELECT o_orderstatus, month(o_orderdate)::INT AS x, avg(o_totalprice) AS y FROM orders GROUP BY ALL)", "fold, position, x", y=3))
def curves(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("fold"), F.month("o_orderdate").alias("x"), F.col("o_totalprice").alias("y"))
    return rounded(W.curves(o, "fold", "x", "y"), 3)


def part_facets():
    size = bin_scale(F.col("p_size"), [20, 40], ["small", "medium", "large"])
    return {"brand": F.col("p_brand"), "type": F.col("p_type"), "type_size": F.concat_ws("|", "p_type", size), "size": size}


@query("representative")
def representative(spark, d):
    out = W.representative_sample(table(spark, d, "part"), part_facets(), ["p_partkey"], "type_size")
    return out.withColumn("gained", F.array_join("gained", ";"))


@query("cover_manifest")
def cover_manifest(spark, d):
    part = table(spark, d, "part")
    picked = W.representative_sample(part, part_facets(), ["p_partkey"], "type_size")
    return W.cover_manifest(part, part.join(F.broadcast(picked.select("p_partkey")), "p_partkey", "left_semi"), part_facets())


@query("sample_n", "SELECT p_partkey, p_brand FROM part ORDER BY md5('11|' || p_partkey), p_partkey LIMIT 100")
def sample_n(spark, d):
    return W.sample_n(table(spark, d, "part").select("p_partkey", "p_brand"), ["p_partkey"], 100, 11)


# ---- plans -----------------------------------------------------------------------------------

@query("strategy_plan", "WITH c AS (SELECT DISTINCT o_orderpriority AS algorithm FROM orders), s(objective, weighted) AS (VALUES ('absolute_error', false), ('squared_error', false), ('absolute_error', true), ('pseudo_huber', false)) SELECT algorithm, objective, weighted, algorithm || '__' || objective || '__' || CASE WHEN weighted THEN 'weighted' ELSE 'unweighted' END AS strategy_id FROM c, s WHERE objective <> 'pseudo_huber' OR algorithm = '1-URGENT'")
def strategy_plan(spark, d):
    short = table(spark, d, "orders").select(F.col("o_orderpriority").alias("algorithm")).distinct()
    return M.strategy_plan(short, "algorithm", ["1-URGENT"])


@query("sample_candidates", "SELECT DISTINCT p_brand, p_size, p_type FROM part ORDER BY md5('3|' || p_brand || '|' || p_size || '|' || p_type), p_brand, p_size, p_type LIMIT 8")
def sample_candidates(spark, d):
    return M.sample_candidates(table(spark, d, "part").select("p_type", "p_brand", "p_size").distinct(), 8, 3)


@query("sample_candidates_by", "SELECT p_brand, p_size, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY md5('3|' || p_brand || '|' || p_size || '|' || p_type), p_brand, p_size, p_type) AS r FROM (SELECT DISTINCT p_brand, p_size, p_type FROM part)) WHERE r <= 4")
def sample_candidates_by(spark, d):
    return M.sample_candidates(table(spark, d, "part").select("p_type", "p_brand", "p_size").distinct(), 4, 3, ["p_type"])


@query("matrix_progress", """WITH plan AS (SELECT o_orderpriority AS task, o_orderstatus AS hw, o_orderpriority || '__' || o_orderstatus AS experiment_id FROM (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders)),
res AS (SELECT o_orderpriority || '__' || o_orderstatus AS experiment_id, count(*) AS n FROM orders WHERE o_totalprice > 400000 AND o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT experiment_id, task, hw, CASE WHEN task = '1-URGENT' THEN 0 ELSE coalesce(n, 0) END AS n_rows, CASE WHEN n IS NULL THEN 'missing' WHEN task = '1-URGENT' THEN 'stale' ELSE 'complete' END AS status FROM plan LEFT JOIN res USING (experiment_id)""")
def matrix_progress(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("hw"), "o_totalprice")
    ident = F.concat_ws("__", "task", "hw")
    plan = M.with_fingerprint(o.select("task", "hw", ident.alias("experiment_id")).distinct(), {"data": "v1"})
    rows = o.where((F.col("o_totalprice") > 400000) & (F.col("task") != "5-LOW")).withColumn("experiment_id", ident)
    results = rows.join(plan.select("experiment_id", "fingerprint"), "experiment_id").withColumn(
        "fingerprint", F.when(F.col("task") == "1-URGENT", "old").otherwise(F.col("fingerprint")))
    return M.matrix_progress(plan, results).drop("fingerprint")


# ---- splits ----------------------------------------------------------------------------------

@query("group_folds", f"WITH {B.folds_sql('(SELECT l_suppkey FROM lineitem)', 'l_suppkey', 7, 5, 'f')} SELECT * FROM f")
def group_folds(spark, d):
    return T.group_folds(table(spark, d, "lineitem").select("l_suppkey"), "l_suppkey", 5, 7)


@query("isolation", f"WITH {B.FOLDED_SQL} SELECT count(*) AS n_groups, count(*) FILTER (k > 1) AS n_crossing FROM (SELECT model, count(DISTINCT fold) AS k FROM folded GROUP BY 1)")
def isolation(spark, d):
    return T.isolation(B.folded_runs(spark, d), "model", "fold")


@query("logo", "SELECT l_suppkey, n_rows, row_number() OVER (ORDER BY l_suppkey) - 1 AS fold FROM (SELECT l_suppkey, count(*) AS n_rows FROM lineitem GROUP BY 1)")
def logo(spark, d):
    return T.leave_group_out(table(spark, d, "lineitem"), "l_suppkey")


@query("within_logo", "WITH c AS (SELECT o_orderpriority, o_custkey, count(*) AS n_rows FROM orders GROUP BY ALL), w AS (SELECT o_orderpriority FROM c GROUP BY 1 HAVING count(*) >= 3) SELECT o_orderpriority, o_custkey, n_rows, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) - 1 AS fold FROM c WHERE o_orderpriority IN (SELECT o_orderpriority FROM w)")
def within_logo(spark, d):
    return T.leave_group_within(table(spark, d, "orders"), "o_orderpriority", "o_custkey")


@query("random_splits", "SELECT c_custkey, repeat::INT AS repeat, row_number() OVER (PARTITION BY repeat ORDER BY md5('9|' || repeat || '|' || c_custkey), c_custkey) <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY repeat)) AS is_test FROM customer, range(10) r(repeat)")
def random_splits(spark, d):
    return T.random_splits(table(spark, d, "customer"), "c_custkey", 0.2, 10, 9)


@query("holdout", "WITH p AS (SELECT arg_min(c_custkey, sha256('7|' || c_nationkey || '|' || c_custkey)) AS c_custkey FROM customer GROUP BY c_nationkey HAVING count(*) >= 2) SELECT c_custkey, c_custkey IN (SELECT c_custkey FROM p) AS is_holdout FROM customer")
def holdout(spark, d):
    return T.holdout_flags(table(spark, d, "customer"), "c_nationkey", "c_custkey", 7)


@query("holdout_split", "WITH p AS (SELECT arg_min(c_custkey, sha256('7|' || c_nationkey || '|' || c_custkey)) AS c_custkey FROM customer GROUP BY c_nationkey HAVING count(*) >= 2) SELECT CASE WHEN c_custkey IN (SELECT c_custkey FROM p) THEN 'confirmatory' ELSE 'development' END AS part, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL")
def holdout_split(spark, d):
    dev, conf = T.lock_holdout(table(spark, d, "customer"), "c_nationkey", "c_custkey", 7)
    return dev.withColumn("part", F.lit("development")).unionByName(conf.withColumn("part", F.lit("confirmatory"))).groupBy("part", "c_mktsegment").agg(F.count("*").alias("n"))


@query("oof_mean", rsql(f"WITH {B.OOF_SQL} SELECT run_key, fold, prediction FROM oof WHERE strategy = 'total_raw'", "run_key, fold", prediction=3))
def oof_mean(spark, d):
    return rounded(B.oof(spark, d).select("run_key", "fold", "prediction"), 3)


@query("oof_mean_per_unit", rsql(f"WITH {B.OOF_SQL} SELECT run_key, fold, prediction FROM oof WHERE strategy = 'unit_raw'", "run_key, fold", prediction=3))
def oof_mean_per_unit(spark, d):
    return rounded(B.oof(spark, d, "unit_raw").select("run_key", "fold", "prediction"), 3)
