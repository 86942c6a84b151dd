"""Join, projection, set and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import base as B
from plumbline.catalog.profiling import DOCS_SQL, labelled_documents
from plumbline.catalog.registry import query, rounded, rsql, table
from plumbline.functions import predicates as R
from plumbline.operators import gates as G
from plumbline.operators import joins as J
from plumbline.operators import sets as S
from plumbline.plans.bundles import resolve_bundles, select_bundle
from plumbline.sources.readers import dim, read_runs
from plumbline.sources.views import literal_view, snapshot, view_of


@query("join_validated", rsql("SELECT n_name, c_mktsegment, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL", "n_name, c_mktsegment, n_orders", total=2))
def join_validated(spark, d):
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
    orders = table(spark, d, "orders").select("o_custkey", "o_totalprice")
    joined = J.join_validated(J.join_validated(orders, customer, "o_custkey"), table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return rounded(joined.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total")), 2)


@query("join_hot_keys", rsql("SELECT p_brand, count(*) AS n_lines, sum(l_extendedprice) AS total FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1", "p_brand, n_lines", total=2))
def join_hot_keys(spark, d):
    """Each side read once, hot keys split while the query runs."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    joined = J.join_many_to_one(table(spark, d, "lineitem").select("l_partkey", "l_extendedprice"), part, "l_partkey")
    return rounded(joined.groupBy("p_brand").agg(F.count("*").alias("n_lines"), F.sum("l_extendedprice").alias("total")), 2)


@query("one_to_one_join", "SELECT o_orderkey, n_lines, o_orderpriority FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def one_to_one_join(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    return J.join_validated(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), lines, "o_orderkey", "inner", "one_to_one")


@query("composite_join", rsql("SELECT task, hw, count(*) AS n, avg(y - m) AS mean_gap FROM (SELECT o_orderpriority AS task, o_orderstatus AS hw, o_totalprice AS y FROM orders) JOIN (SELECT o_orderpriority AS task, o_orderstatus AS hw, min(o_totalprice) AS m FROM orders GROUP BY ALL) USING (task, hw) GROUP BY ALL", "task, hw, n", mean_gap=3))
def composite_join(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("hw"), F.col("o_totalprice").alias("y"))
    floors = runs.groupBy("task", "hw").agg(F.min("y").alias("m"))
    joined = J.join_validated(runs, floors, ["task", "hw"], "inner")
    return rounded(joined.groupBy("task", "hw").agg(F.count("*").alias("n"), F.avg(F.col("y") - F.col("m")).alias("mean_gap")), 3)


@query("enrich", "SELECT s_suppkey, s_nationkey, n_name, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def enrich(spark, d):
    nation = table(spark, d, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    return J.enrich(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), nation, "s_nationkey")


@query("semi", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi(spark, d):
    keys = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.only_keys(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), keys, "o_orderkey")


@query("anti", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti(spark, d):
    keys = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.except_keys(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), keys, "o_orderkey")


@query("merge_prior", "SELECT o_orderkey, CASE WHEN p.status = 'available' OR u.total IS NULL THEN p.status ELSE 'available' END AS status, coalesce((CASE WHEN p.status = 'available' OR u.total IS NULL THEN p.total ELSE u.total END)::VARCHAR, '') AS total FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'available' ELSE 'missing' END AS status, CASE WHEN o_orderstatus = 'F' THEN 10 END AS total FROM orders) p LEFT JOIN (SELECT l_orderkey, count(*) AS total FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) u ON l_orderkey = o_orderkey")
def merge_prior(spark, d):
    done = F.col("o_orderstatus") == "F"
    prior = table(spark, d, "orders").select("o_orderkey", F.when(done, "available").otherwise("missing").alias("status"), F.when(done, F.lit(10).cast("bigint")).alias("total"))
    updates = table(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.lit("available").alias("status"), F.count("*").alias("total"))
    return J.merge_prior(prior, updates, "o_orderkey", "status").withColumn("total", F.coalesce(F.col("total").cast("string"), F.lit("")))


RECON_SQL = """SELECT o_orderkey, CASE WHEN s IS NULL THEN 'missing_value' WHEN c = 4 THEN 'all_requests_completed' ELSE 'incomplete_run_diagnostic' END AS comparison_scope,
CASE WHEN s IS NULL THEN 'not_comparable_missing_value' WHEN c <> 4 THEN 'not_comparable_incomplete_run' WHEN s = 100 THEN 'exact' ELSE 'mismatch_unresolved_historical_equivalence' END AS reconciliation_status,
s - 100 AS absolute_error, (s - 100) / 100 AS relative_error FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS s, count(*) AS c FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""


@query("reconcile", rsql(RECON_SQL, "o_orderkey, comparison_scope, reconciliation_status", absolute_error=4, relative_error=6))
def reconcile(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("actual"), F.count("*").alias("completed"))
    joined = J.join_many_to_one(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey").withColumns({"planned": F.lit(100.0), "planned_count": F.lit(4)})
    out = J.reconcile(joined, "planned", "actual", "completed", "planned_count")
    return rounded(out.select("o_orderkey", "comparison_scope", "reconciliation_status", "absolute_error", "relative_error"), 6, absolute_error=4)


@query("reconcile_summary", f"SELECT reconciliation_status, count(*) AS n FROM ({RECON_SQL}) GROUP BY 1")
def reconcile_summary(spark, d):
    return reconcile(spark, d).groupBy("reconciliation_status").agg(F.count("*").alias("n"))


@query("cross_plan", "SELECT o_orderpriority, o_orderstatus, y::INT AS y FROM (SELECT DISTINCT o_orderpriority FROM orders), (SELECT DISTINCT o_orderstatus FROM orders), (SELECT DISTINCT year(o_orderdate) AS y FROM orders)")
def cross_plan(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", F.year("o_orderdate").cast("int").alias("y"))
    return J.data_plan(o, ["o_orderpriority", "o_orderstatus", "y"])


PAIRED_SQL = f"""{B.OOF_SQL},
paired AS (SELECT a.run_key, a.model, a.y, a.prediction AS prediction_before, b.prediction AS prediction_after
  FROM oof a JOIN oof b ON a.run_key = b.run_key WHERE a.strategy = 'total_raw' AND b.strategy = 'unit_raw')"""


def paired(spark, d):
    rows = B.oof_wide(spark, d, "total_raw", "unit_raw")
    before, after = (rows.select("run_key", "model", "y", F.col(f"p_{n}").alias("prediction")) for n in ("total_raw", "unit_raw"))
    return J.pair_predictions(before, after, "run_key", "prediction", ["model", "y"])


@query("pair_predictions", rsql(f"WITH {PAIRED_SQL} SELECT * FROM paired", "run_key, model, y", prediction_before=3, prediction_after=3))
def pair_predictions(spark, d):
    return rounded(paired(spark, d), 3, y=6)


@query("attach_folds", f"WITH {B.FOLDED_SQL} SELECT run_key, model, fold FROM folded")
def attach_folds(spark, d):
    return B.folded_runs(spark, d).select("run_key", "model", "fold")


@query("pair_variants", rsql(f"WITH {B.OOF_SQL} SELECT run_key, max(residual) FILTER (strategy = 'total_raw') AS residual_total_raw, max(residual) FILTER (strategy = 'unit_raw') AS residual_unit_raw FROM oof GROUP BY 1", "run_key", residual_total_raw=3, residual_unit_raw=3))
def pair_variants(spark, d):
    return rounded(J.pair_variants(B.oof_long(spark, d), ["run_key"], "strategy", ["total_raw", "unit_raw"], "residual"), 3)


@query("residual_features", rsql(f"WITH {B.OOF_SQL} SELECT hw, count(*) AS n, corr(residual, qty) AS r FROM oof JOIN (SELECT run_key, coalesce(qty, 0) AS qty FROM runs) USING (run_key) WHERE strategy = 'total_raw' GROUP BY 1", "hw, n", r=6))
def residual_features(spark, d):
    pred = B.oof(spark, d).select("run_key", "hw", (F.col("prediction") - F.col("y")).alias("residual"))
    feats = B.runs(spark, d).select("run_key", F.coalesce("qty", F.lit(0.0)).alias("qty"))
    joined = J.residual_features(pred, feats, "run_key")
    return rounded(joined.groupBy("hw").agg(F.count("*").alias("n"), F.corr("residual", "qty").alias("r")))


@query("expand_pairs", rsql("SELECT run_key, task, hw, n_lines * reps AS n_lines, total * reps AS total, mean FROM (SELECT o_orderkey AS run_key, o_orderpriority AS task, o_orderstatus AS hw, 1 + o_orderkey % 3 AS reps FROM orders) JOIN (SELECT o_orderpriority AS task, o_orderstatus AS hw, count(*) AS n_lines, sum(o_totalprice) AS total, avg(o_totalprice) AS mean FROM orders GROUP BY ALL) USING (task, hw)", "run_key, task, hw, n_lines", total=2, mean=4))
def expand_pairs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_key"), F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("hw"), "o_totalprice")
    stats = o.groupBy("task", "hw").agg(F.count("*").alias("n_lines"), F.sum("o_totalprice").alias("total"), F.avg("o_totalprice").alias("mean"))
    out = J.expand_pairs(o.select("run_key", "task", "hw", (1 + F.col("run_key") % 3).alias("reps")), stats, ["task", "hw"], "reps", ["n_lines", "total"])
    return rounded(out.drop("reps"), 2, mean=4)


DIFF_SQL = "(SELECT o_orderkey, o_totalprice, o_orderstatus, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 400000 THEN 0 ELSE o_totalprice END AS p2 FROM orders)"


@query("amend", f"SELECT o_orderkey, o_orderstatus, p2 AS o_totalprice FROM {DIFF_SQL}")
def amend(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return R.amend(o, (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000), ["o_totalprice"], F.lit(0.0))


@query("frames_differ", f"SELECT 'rows only in first' AS what, 0::BIGINT AS n UNION ALL SELECT 'rows only in second', 0 UNION ALL SELECT 'o_totalprice', count(*) FILTER (p2 <> o_totalprice) FROM {DIFF_SQL} UNION ALL SELECT 'o_orderstatus', 0")
def frames_differ(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return J.frames_differ(o, amend(spark, d), "o_orderkey", ["o_totalprice", "o_orderstatus"])


# ---- projection and mapping ------------------------------------------------------------------

@query("project", "SELECT p_brand AS x_brand, p_size AS x_size, p_retailprice AS x_price FROM part")
def project(spark, d):
    return R.project(table(spark, d, "part"), {"p_brand": "brand", "p_size": "size", "p_retailprice": "price"}, "x_")


# Example label mapping.
PRIORITY_RANK = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}


@query("map_values", "SELECT o_orderkey, substr(o_orderpriority, 1, 1)::INT AS rank FROM orders")
def map_values(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.map_values(F.col("o_orderpriority"), PRIORITY_RANK, required=True).alias("rank"))


@query("prefix_family", "SELECT page_id, CASE WHEN r LIKE 'blog.%' THEN 'blog' WHEN r LIKE 'm.%' THEN 'mobile' ELSE r END AS family FROM (SELECT page_id, split_part(url, '://', 2) AS r FROM pages)")
def prefix_family(spark, d):
    rest = F.concat(F.lit("host/"), F.substring_index("url", "://", -1))
    return table(spark, d, "pages").select("page_id", R.prefix_family(rest, [("blog.", "blog"), ("m.", "mobile")]).alias("family"))


@query("fill_status", f"SELECT doc_id, coalesce(quality, fallback)::VARCHAR AS quality, CASE WHEN quality IS NOT NULL THEN 'observed' WHEN fallback IS NOT NULL THEN 'filled' ELSE 'missing' END AS quality_status FROM (SELECT *, CASE WHEN lang = 'en' THEN 0 END AS fallback FROM {DOCS_SQL})".replace("::VARCHAR AS quality", "::VARCHAR AS quality"))
def fill_status(spark, d):
    docs = labelled_documents(spark, d).withColumn("fallback", F.when(F.col("lang") == "en", 0))
    return R.fill_with_status(docs, "quality", "fallback").select("doc_id", F.col("quality").cast("string").alias("quality"), "quality_status")


@query("complete_cases", f"SELECT doc_id, lang, quality, toxic FROM {DOCS_SQL} WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def complete_cases(spark, d):
    return R.complete_cases(labelled_documents(spark, d).select("doc_id", "lang", "quality", "toxic"), ["quality", "toxic"]).withColumns(
        {c: F.col(c).cast("int") for c in ("quality", "toxic")})


BUNDLES = {"B0": {"categorical": ["o_orderpriority"]}, "B1": {"base": "B0", "numeric_add": ["o_totalprice"], "categorical_add": ["o_orderstatus"]},
           "B2": {"base": "B1", "drop": ["o_orderpriority"]}}


@query("bundle_select", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def bundle_select(spark, d):
    return select_bundle(table(spark, d, "orders"), resolve_bundles(BUNDLES), "B2", "o_orderkey")


@query("filter_plan", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def filter_plan(spark, d):
    return R.filter_plan(table(spark, d, "orders").select("o_orderpriority", "o_orderstatus").distinct(), o_orderstatus=["F", "P"])


# ---- sets ------------------------------------------------------------------------------------

SIDES = "SELECT l_quantity, l_discount, l_tax, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS b FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL"
SIDE_COLS = ["l_quantity", "l_discount", "l_tax"]


def sides(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'R'")


@query("multiset_diff", f"SELECT sum(greatest(a - b, 0))::BIGINT AS only_in_a, sum(greatest(b - a, 0))::BIGINT AS only_in_b, sum(abs(a - b))::BIGINT AS total_difference FROM ({SIDES})")
def multiset_diff(spark, d):
    return S.multiset_diff(*sides(spark, d), SIDE_COLS)


@query("multiset_rows", f"SELECT l_quantity, l_discount, l_tax, a - b AS surplus FROM ({SIDES}) WHERE a <> b")
def multiset_rows(spark, d):
    return S.multiset_rows(*sides(spark, d), SIDE_COLS)


SUPPORT = "SELECT l_suppkey, l_partkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS b FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL"


@query("support_equal", f"SELECT sum(a)::BIGINT AS rows_a, sum(b)::BIGINT AS rows_b, count(*) FILTER (a > 0 AND b = 0) AS n_only_a, count(*) FILTER (a = 0 AND b > 0) AS n_only_b, count(*) FILTER (a > 1 OR b > 1) AS n_repeated, false AS same_support FROM ({SUPPORT})")
def support_equal(spark, d):
    return S.support(*sides(spark, d), ["l_suppkey", "l_partkey"])


@query("assert_disjoint", f"SELECT count(*) FILTER (a > 0 AND b > 0) AS n_overlap, count(*) FILTER (a > 0 AND b = 0) AS n_only_a, count(*) FILTER (a = 0 AND b > 0) AS n_only_b FROM ({SUPPORT})")
def assert_disjoint(spark, d):
    return S.overlap(*sides(spark, d), ["l_suppkey", "l_partkey"])


@query("schema_diff", "SELECT column_name AS \"column\", 'orders' AS side FROM (SELECT 'o_orderdate' AS column_name UNION ALL SELECT 'o_totalprice') WHERE (SELECT count(*) FROM orders) > 0 UNION ALL SELECT 'o_year', 'derived' WHERE (SELECT count(*) FROM orders) > 0")
def schema_diff(spark, d):
    o = table(spark, d, "orders")
    derived = o.withColumn("o_year", F.year("o_orderdate")).drop("o_orderdate", "o_totalprice")
    only_o, only_d = S.schema_diff(o, derived)
    some = o.agg(F.count("*").alias("n"))
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(s).alias("side")) for s, cs in (("orders", only_o), ("derived", only_d)) for c in cs])
    return some.where("n > 0").select(F.inline(rows))


@query("union_all", "SELECT 'customer' AS kind, c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier")
def union_all(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return S.union_all([c, s])


@query("dedupe_cohorts", "SELECT flag, min(flag) OVER (PARTITION BY ks) AS cohort, n_keys, count(*) OVER (PARTITION BY ks) AS n_flags FROM ("
       + " UNION ALL ".join(f"SELECT '{n}' AS flag, (SELECT count(*) FROM orders WHERE {c}) AS n_keys, (SELECT md5(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) FROM orders WHERE {c}) AS ks" for n, c in (
           ("base", "o_totalprice > 0"), ("full", "o_orderpriority IS NOT NULL"), ("big", "o_totalprice > 300000"))) + ")")
def dedupe_cohorts(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") > 0).alias("base"), F.col("o_orderpriority").isNotNull().alias("full"), (F.col("o_totalprice") > 300000).alias("big"))
    return S.dedupe_cohorts(o, "o_orderkey", ["base", "full", "big"])


# ---- sources as queries ----------------------------------------------------------------------

@query("read_runs", rsql("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1", "l_returnflag, n", qty=3))
def read(spark, d):
    lines = read_runs(spark, f"{d}/lineitem.parquet", "l_returnflag", ["A", "N"])
    return rounded(lines.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty")), 3)


PROFILES = {"F": {"rated": 700.0, "capacity": 80.0}, "O": {"rated": 1000.0, "capacity": 180.0}, "P": {"rated": 500.0, "capacity": None}}


@query("dim_view", "SELECT o_orderkey, o_orderstatus, rated, coalesce(capacity, -1)::DOUBLE AS capacity FROM orders JOIN (VALUES ('F', 700.0::DOUBLE, 80.0::DOUBLE), ('O', 1000.0, 180.0), ('P', 500.0, NULL)) p(status, rated, capacity) ON o_orderstatus = status")
def dim_view(spark, d):
    return J.enrich(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), dim(spark, PROFILES, "o_orderstatus"), "o_orderstatus").withColumn(
        "capacity", F.coalesce("capacity", F.lit(-1.0)))


@query("literal_view", "SELECT o_orderstatus, label, count(*) AS n FROM orders JOIN (VALUES ('F', 'finished'), ('O', 'open''s'), ('P', 'partial')) v(status, label) ON o_orderstatus = status GROUP BY ALL")
def literal(spark, d):
    labels = literal_view(spark, "plumbline_status_labels", [{"o_orderstatus": "F", "label": "finished"}, {"o_orderstatus": "O", "label": "open's"}, {"o_orderstatus": "P", "label": "partial"}])
    return J.enrich(table(spark, d, "orders").select("o_orderstatus"), labels, "o_orderstatus").groupBy("o_orderstatus", "label").agg(F.count("*").alias("n"))


@query("snapshot", """SELECT 'status' AS dataset, '{"o_orderstatus":"' || o_orderstatus || '","n":' || count(*)::VARCHAR || '}' AS row_json FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'returns', '{"l_returnflag":"' || l_returnflag || '","n":' || count(*)::VARCHAR || '}' FROM lineitem GROUP BY l_returnflag""")
def snap(spark, d):
    status = view_of("plumbline_status", table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")))
    return snapshot({"status": status, "returns": table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))})


@query("file_inventory")
def inventory(spark, d):
    from plumbline.sources.readers import file_inventory
    return file_inventory(spark, d, "*.parquet", deny_suffix=[".bin"]).select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256", "allowed")


# ---- gates -----------------------------------------------------------------------------------

def _gate_sql(src: str, entries: list[tuple[str, str, str]]) -> str:
    """(name, observed expression, expected text) checks over one aggregate row."""
    return " UNION ALL ".join(
        f"SELECT '{n}' AS name, CASE WHEN ({o})::VARCHAR = '{e}' THEN 'pass' ELSE 'fail' END AS status, ({o})::VARCHAR AS observed, '{e}' AS expected FROM {src}" for n, o, e in entries)


@query("gates_population", _gate_sql("nation", [("row_count", "count(*)", "25"), ("first_count", "count(*) FILTER (n_regionkey = 0)", "5")]))
def gates_population(spark, d):
    return G.check_population(table(spark, d, "nation").withColumn("first", F.col("n_regionkey") == 0), 25, "first", 5)


@query("gates_unique", _gate_sql("orders", [("unique:o_orderkey", "count(*) - count(DISTINCT o_orderkey)", "0")]) + " UNION ALL "
       + _gate_sql("(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)", [("unique:l_orderkey,l_linenumber", "count(*) FILTER (n > 1)", "0")]))
def gates_unique(spark, d):
    return G.check_unique(table(spark, d, "orders"), ["o_orderkey"]).unionByName(G.check_unique(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query("gates_ranges", _gate_sql("lineitem", [("positive:l_quantity", "count(*) FILTER (NOT coalesce(l_quantity > 0, false))", "0"), ("positive:l_discount", "count(*) FILTER (NOT coalesce(l_discount > 0, false))", "0"),
                                             ("nonnegative:l_tax", "count(*) FILTER (l_tax < 0)", "0"), ("present:l_shipdate", "count(*) - count(l_shipdate)", "0")]))
def gates_ranges(spark, d):
    return G.check_ranges(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], ["l_tax"], ["l_shipdate"])


@query("gates_flags", _gate_sql("orders", [("recompute:base", "sum(0)", "0"), ("recompute:full", "count(*) FILTER (o_totalprice > 200000 AND o_orderstatus = 'P')", "0"), ("implies:full->base", "sum(0)", "0")]))
def gates_flags(spark, d):
    o = table(spark, d, "orders").withColumns({"base": F.col("o_totalprice") > 100000, "full": F.col("o_totalprice") > 200000})
    return G.check_flags(o, {"base": F.col("o_totalprice") > 100000, "full": (F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") != "P")}, ["base", "full"])


@query("gates_formula", _gate_sql("(SELECT *, round(l_extendedprice * (1 - l_discount), 2) AS net FROM lineitem)", [
    ("formula:net", "count(*) FILTER (abs(net - l_extendedprice * (1 - l_discount)) / greatest(abs(net), abs(l_extendedprice * (1 - l_discount)), 1e-12) > 1e-6)", "0")]))
def gates_formula(spark, d):
    exact = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return G.check_formula(table(spark, d, "lineitem").withColumn("net", F.round(exact, 2)), {"net": exact}, 1e-6)


@query("gates_summary", _gate_sql(f"(SELECT DISTINCT reconciliation_status AS s FROM ({RECON_SQL}))", [
    ("summary:keys", "count(*) FILTER (s = 'exact')", "0"), ("summary:n", "count(*) FILTER (s = 'exact' OR s LIKE 'not%')", "0")]))
def gates_summary(spark, d):
    """The stored summary lacks one status and counts the incomparable ones wrong."""
    stored = reconcile_summary(spark, d).where("reconciliation_status <> 'exact'").withColumn(
        "n", F.col("n") + F.col("reconciliation_status").startswith("not").cast("int"))
    return G.check_summary(reconcile(spark, d), stored, ["reconciliation_status"])


@query("gates_roles", _gate_sql("(SELECT 1)", [("roles:missing", "0", "0"), ("roles:extra", "2", "0"), ("roles:changed", "0", "0")]))
def gates_roles(spark, d):
    from plumbline.catalog.profiling import CONTRACT, role_manifest
    contract = dim(spark, {k: {"role": v} for k, v in CONTRACT.items() if k != "x_size"}, "column")
    return G.check_roles(role_manifest(spark, d), contract)


@query("gates_boundary", _gate_sql("lineitem", [("boundary:B1", "sum(0)", "0"), ("complete:B1", "count(*) - count(l_quantity)", "0"), ("boundary:B2", "max(2)", "0"), ("complete:B2", "count(*) - count(l_quantity)", "0")]))
def gates_boundary(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x_quantity"), F.col("l_extendedprice").alias("y_price"))
    return G.check_boundary(lines, {"B1": ["x_quantity"], "B2": ["x_quantity", "y_price"]}, {"x_quantity": "X_workload"}, ["X_workload"], forbid=["price"])


@query("gates_revisions", _gate_sql("(SELECT md5(o_orderkey::VARCHAR) || CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE '00000000' END AS rev, o_orderstatus AS acc, o_orderkey FROM orders)", [
    ("revisions:hex40", "count(*) FILTER (NOT regexp_full_match(rev, '[0-9a-f]{40}'))", "0"),
    ("revisions:access", "count(*) FILTER (acc NOT IN ('F', 'O'))", "0"), ("revisions:static_only", "sum(0)", "0")]) + " UNION ALL SELECT 'revisions:count', 'pass', count(DISTINCT o_orderkey)::VARCHAR, count(*)::VARCHAR FROM orders")
def gates_revisions(spark, d):
    o = table(spark, d, "orders")
    rev = F.concat(F.md5(F.col("o_orderkey").cast("string")), F.when(F.col("o_orderkey") % 10 == 0, "").otherwise("00000000"))
    return G.check_revisions(o.withColumns({"rev": rev, "sta": F.lit(True)}), "o_orderkey", "rev", "o_orderstatus", ["F", "O"], "sta", o.count())
