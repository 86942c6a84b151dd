"""Audit queries: nulls, duplicates, keys, coverage, distributions, identities, lengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.registry import each, query, rounded, rsql, table
from plumbline.functions.documents import flatten_json
from plumbline.functions.predicates import cols_with_prefix
from plumbline.operators import profile as P
from plumbline.operators.joins import join_many_to_one, join_validated, paired_key_counts
from plumbline.operators.ordering import quantile_columns


def labelled_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return join_validated(docs, table(spark, d, "labels"), "doc_id", cardinality="many_to_one")


DOCS_SQL = "(SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))"
DOC_COLS = ["lang", "source", "quality", "toxic"]


@query("null_profile", rsql(each(DOC_COLS, f"SELECT '{{c}}' AS \"column\", count(*) - count({{c}}) AS null_count, (count(*) - count({{c}}))::DOUBLE / count(*) AS null_rate, count(*) AS n_rows FROM {DOCS_SQL}"), '"column", null_count, n_rows', null_rate=6))
def null_profile(spark, d):
    return rounded(P.null_profile(labelled_documents(spark, d), DOC_COLS))


@query("null_profile_by_group", rsql(each(["quality", "toxic"], f"SELECT lang, '{{c}}' AS \"column\", count(*) - count({{c}}) AS null_count, (count(*) - count({{c}}))::DOUBLE / count(*) AS null_rate, count(*) AS n_rows FROM {DOCS_SQL} GROUP BY lang"), 'lang, "column", null_count, n_rows', null_rate=6))
def null_profile_by_group(spark, d):
    return rounded(P.null_profile(labelled_documents(spark, d), ["quality", "toxic"], ["lang"]))


@query("missingness", rsql(each(DOC_COLS, f"SELECT '{{c}}' AS \"column\", count({{c}}) AS available, count(*) - count({{c}}) AS missing, count({{c}})::DOUBLE / count(*) AS coverage FROM {DOCS_SQL}"), '"column", available, missing', coverage=6))
def missingness(spark, d):
    return rounded(P.missingness(labelled_documents(spark, d), DOC_COLS))


@query("blank_profile", each(["text", "lang", "source"], "SELECT '{c}' AS \"column\", count(*) FILTER (trim({c}) = '') AS blank_count FROM documents"))
def blank_profile(spark, d):
    return P.blank_profile(table(spark, d, "documents"))


def _dups_sql(cols: str, src: str) -> str:
    return (f"SELECT count(*) AS distinct_rows, count(*) FILTER (n > 1) AS duplicate_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT "
            f"AS rows_in_duplicate_groups FROM (SELECT {cols}, count(*) AS n FROM {src} GROUP BY ALL)")


@query("exact_dups", _dups_sql("*", "lineitem"))
def exact_dups(spark, d):
    return P.exact_duplicates(table(spark, d, "lineitem"))


@query("exact_dups_text", _dups_sql("lang, text", "documents"))
def exact_dups_text(spark, d):
    return P.exact_duplicates(table(spark, d, "documents"), ["lang", "text"])


LINE_KEY = ["l_orderkey", "l_linenumber"]
KEYS_SQL = "(SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)"


@query("key_profile", f"SELECT count(*) AS unique_keys, count(*) FILTER (n > 1) AS duplicate_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS rows_in_duplicate_groups, max(n) AS max_multiplicity FROM {KEYS_SQL}")
def key_profile(spark, d):
    return P.key_profile(table(spark, d, "lineitem"), LINE_KEY)


@query("key_multiplicity", f"SELECT n AS multiplicity, count(*) AS n_keys FROM {KEYS_SQL} GROUP BY 1")
def key_multiplicity(spark, d):
    return P.key_multiplicity(table(spark, d, "lineitem"), LINE_KEY)


@query("duplicate_examples", f"SELECT * FROM {KEYS_SQL} WHERE n > 1 ORDER BY l_orderkey, l_linenumber LIMIT 20")
def duplicate_examples(spark, d):
    return P.duplicate_examples(table(spark, d, "lineitem"), LINE_KEY, 20)


@query("duplicated_rows", "SELECT l_returnflag, n > 1 AS is_duplicated, count(*) AS n_rows FROM (SELECT l_returnflag, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) GROUP BY ALL")
def duplicated_rows(spark, d):
    rows = table(spark, d, "lineitem").select(*LINE_KEY, "l_returnflag")
    return P.duplicated(rows, LINE_KEY).groupBy("l_returnflag", "is_duplicated").agg(F.count("*").alias("n_rows"))


@query("value_counts", each(["o_orderstatus", "o_orderpriority"], "SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM orders GROUP BY ALL"))
def value_counts(spark, d):
    return P.value_counts(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("cross_tab", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def cross_tab(spark, d):
    return P.cross_tab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


@query("cross_pivot", 'SELECT o_orderpriority, count(*) FILTER (o_orderstatus = \'F\') AS "F", count(*) FILTER (o_orderstatus = \'O\') AS "O", count(*) FILTER (o_orderstatus = \'P\') AS "P" FROM orders GROUP BY 1')
def cross_pivot(spark, d):
    return P.cross_pivot(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _numeric_sql(by: str = "") -> str:
    lead, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    stats = each(NUM, f"SELECT {lead}'{{c}}' AS \"column\", min({{c}}) AS minimum, quantile_cont({{c}}, 0.25) AS q1, median({{c}}) AS median, quantile_cont({{c}}, 0.75) AS q3, max({{c}}) AS maximum FROM lineitem{group}")
    rows = each(NUM, f"SELECT {lead}'{{c}}' AS \"column\", {{c}} AS v FROM lineitem")
    on = f'"column"{", " + by if by else ""}'
    return (f"SELECT {lead}\"column\", any_value(minimum) AS minimum, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3, "
            f"any_value(maximum) AS maximum, count(v) AS count, count(*) FILTER (v <= 0) AS non_positive, "
            f"count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers "
            f"FROM ({stats}) s JOIN ({rows}) r USING ({on}) GROUP BY ALL")


@query("numeric_profile", rsql(_numeric_sql(), '"column", count, non_positive, outliers', minimum=6, q1=6, median=6, q3=6, maximum=6))
def numeric_profile(spark, d):
    return rounded(P.numeric_profile(table(spark, d, "lineitem"), NUM))


@query("numeric_profile_by_group", rsql(_numeric_sql("l_returnflag"), 'l_returnflag, "column", count, non_positive, outliers', minimum=6, q1=6, median=6, q3=6, maximum=6))
def numeric_profile_by_group(spark, d):
    return rounded(P.numeric_profile(table(spark, d, "lineitem"), NUM, ["l_returnflag"]))


@query("iqr_outliers_high", "WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) SELECT event_type, 'value' AS \"column\", count(value) AS count, count(*) FILTER (value <= 0) AS non_positive, count(*) FILTER (value > q3 + 3 * (q3 - q1)) AS outliers FROM events JOIN q USING (event_type) GROUP BY 1")
def iqr_outliers_high(spark, d):
    return P.iqr_outliers(table(spark, d, "events"), ["value"], 3.0, ["event_type"], high_only=True)


DIST = ["l_quantity", "l_extendedprice", "l_discount"]


@query("distribution", rsql(each(DIST, "SELECT '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) AS nunique, min({c}) AS minimum, max({c}) AS maximum, avg({c}) AS mean, stddev_pop({c}) AS std, quantile_cont({c}, 0.05) AS p5, quantile_cont({c}, 0.25) AS p25, median({c}) AS median, quantile_cont({c}, 0.75) AS p75, quantile_cont({c}, 0.95) AS p95, stddev_pop({c}) / abs(avg({c})) AS cv, CASE WHEN quantile_cont({c}, 0.05) > 0 THEN quantile_cont({c}, 0.95) / quantile_cont({c}, 0.05) END AS p95_to_p5, log10(max({c}) FILTER ({c} > 0)) - log10(min({c}) FILTER ({c} > 0)) AS log10_range FROM lineitem"),
                                '"column", n, nunique', minimum=4, maximum=4, mean=4, std=4, p5=4, p25=4, median=4, p75=4, p95=4, cv=6, p95_to_p5=6, log10_range=6))
def distribution(spark, d):
    return rounded(P.distribution(table(spark, d, "lineitem"), DIST), 4, cv=6, p95_to_p5=6, log10_range=6)


def priced_lines(spark, d):
    lines = table(spark, d, "lineitem").select(*LINE_KEY, "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return join_many_to_one(lines, part, "l_partkey")


ERR_SQL = "abs({o} - {e}) / greatest(abs({o}), abs({e}), 1e-12)"
PRODUCT_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ERR_SQL.format(o="l_extendedprice", e="(l_quantity * p_retailprice)") + " AS e FROM lineitem LEFT JOIN part ON p_partkey = l_partkey"
RATIO_SQL = "SELECT " + ERR_SQL.format(o="u", e="(l_extendedprice / nullif(l_quantity, 0))") + " AS e FROM (SELECT *, round(l_extendedprice / l_quantity, 2) AS u FROM lineitem)"


def _identity_sql(errors: str, tol: str) -> str:
    return rsql(f"SELECT count(e) AS checked, count(*) FILTER (e > {tol}) AS failed, max(e) AS max_relative_error, median(e) AS median_relative_error FROM ({errors})",
                "checked, failed", max_relative_error=9, median_relative_error=9)


@query("identity_product", _identity_sql(PRODUCT_SQL, "0.5"))
def identity_product(spark, d):
    return rounded(P.identity_check(priced_lines(spark, d), F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice"), 0.5), 9)


@query("identity_ratio", _identity_sql(RATIO_SQL, "1e-5"))
def identity_ratio(spark, d):
    lines = table(spark, d, "lineitem").withColumn("u", F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2))
    return rounded(P.identity_check(lines, F.col("u"), F.try_divide("l_extendedprice", "l_quantity"), 1e-5), 9)


@query("identity_failures", rsql(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, e AS relative_error FROM ({PRODUCT_SQL}) WHERE e > 0.5 ORDER BY 1, 2, 3, 4 LIMIT 50", "l_orderkey, l_linenumber, l_partkey, l_suppkey", relative_error=9))
def identity_failures(spark, d):
    return rounded(P.identity_failures(priced_lines(spark, d), F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice"),
                                       [*LINE_KEY, "l_partkey", "l_suppkey"], 0.5), 9)


@query("order_check", "SELECT count(*) AS checked, count(*) FILTER (NOT (l_tax <= l_discount AND l_discount <= l_quantity)) AS failed FROM lineitem")
def order_check(spark, d):
    return P.order_check(table(spark, d, "lineitem"), ["l_tax", "l_discount", "l_quantity"])


@query("utilisation", rsql("SELECT l_returnflag, count(r) AS n, min(r) AS minimum, median(r) AS median, max(r) AS maximum, count(*) FILTER (r < 0.85) AS below_floor FROM (SELECT l_returnflag, l_tax / nullif(l_discount, 0) AS r FROM lineitem) WHERE r IS NOT NULL GROUP BY 1", "l_returnflag, n, below_floor", minimum=6, median=6, maximum=6))
def utilisation(spark, d):
    return rounded(P.utilisation(table(spark, d, "lineitem"), "l_tax", "l_discount", 0.85, ["l_returnflag"]))


@query("utilisation_overall", rsql("SELECT count(r) AS n, min(r) AS minimum, median(r) AS median, max(r) AS maximum, count(*) FILTER (r < 0.85) AS below_floor FROM (SELECT l_tax / nullif(l_discount, 0) AS r FROM lineitem) WHERE r IS NOT NULL", "n, below_floor", minimum=6, median=6, maximum=6))
def utilisation_overall(spark, d):
    return rounded(P.utilisation(table(spark, d, "lineitem"), "l_tax", "l_discount"))


@query("predicate_counts", " UNION ALL ".join(f"SELECT '{n}' AS predicate, count(*) FILTER ({p}) AS n_true, count(*) AS n_checked FROM lineitem" for n, p in (
    ("even_key", "l_orderkey % 2 = 0"), ("discounted", "l_discount > 0"), ("tax_below_discount", "l_tax < l_discount"), ("whole_quantity", "l_quantity = floor(l_quantity)"))))
def predicate_counts(spark, d):
    return P.predicate_counts(table(spark, d, "lineitem"), {
        "even_key": F.col("l_orderkey") % 2 == 0, "discounted": F.col("l_discount") > 0,
        "tax_below_discount": F.col("l_tax") < F.col("l_discount"), "whole_quantity": F.col("l_quantity") == F.floor("l_quantity")})


FLAG_SQL = "SELECT *, CASE WHEN event_type <> 'error' THEN value > 50 END AS stable FROM events"


@query("flag_by", rsql(f"SELECT event_type, count(*) AS n_rows, count(*) FILTER (stable) AS n_true, count(*) FILTER (NOT stable) AS n_false, count(*) FILTER (stable IS NULL) AS n_unknown, count(*) FILTER (stable)::DOUBLE / count(*) AS rate_true FROM ({FLAG_SQL}) GROUP BY 1", "event_type, n_rows, n_true, n_false, n_unknown", rate_true=6))
def flag_by(spark, d):
    ev = table(spark, d, "events").withColumn("stable", F.when(F.col("event_type") != "error", F.col("value") > 50))
    return rounded(P.flag_by(ev, "stable", "event_type"))


REASON_SQL = "SELECT CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE replace(o_orderpriority, '-', ': ') END AS reason, o_orderstatus = 'F' AS stable FROM orders"


@query("reason_counts", f"SELECT CASE WHEN trim(split_part(reason, ':', 1)) = '' THEN 'none' ELSE trim(split_part(reason, ':', 1)) END AS category, count(*) AS n FROM ({REASON_SQL}) WHERE NOT stable GROUP BY 1")
def reason_counts(spark, d):
    o = table(spark, d, "orders").select(
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.replace("o_orderpriority", F.lit("-"), F.lit(": "))).alias("reason"),
        (F.col("o_orderstatus") == "F").alias("stable"))
    return P.reason_counts(o, "reason", "stable")


@query("paired_keys", "SELECT count(*) FILTER (a AND b) AS paired_keys, count(*) AS all_keys FROM (SELECT l_partkey, l_suppkey, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'R') AS b FROM lineitem GROUP BY ALL)")
def paired_keys(spark, d):
    return paired_key_counts(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_returnflag", "A", "R")


CELLS = "SELECT o_orderpriority, o_orderstatus, year(o_orderdate) AS y, bool_or(o_totalprice > 495000) AS f FROM orders GROUP BY ALL"


@query("cell_coverage", f"SELECT count(*) AS observed_cells, count(*) FILTER (f) AS flagged_cells, (count(DISTINCT o_orderpriority) * count(DISTINCT o_orderstatus) * count(DISTINCT y))::BIGINT AS cartesian_cells FROM ({CELLS})")
def cell_coverage(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("y"), (F.col("o_totalprice") > 495000).alias("f"))
    return P.cell_coverage(o, ["o_orderpriority", "o_orderstatus", "y"], "f")


@query("group_size", rsql("SELECT count(*) AS n_groups, min(n) AS min_size, max(n) AS max_size, median(n) AS median_size FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)", "n_groups, min_size, max_size", median_size=6))
def group_size(spark, d):
    return rounded(P.group_size_summary(table(spark, d, "lineitem"), ["l_orderkey"]))


@query("members", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def members(spark, d):
    return P.members(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag")


@query("member_counts", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_members FROM lineitem GROUP BY 1")
def member_counts(spark, d):
    return P.member_counts(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


def _coverage_sql() -> str:
    src = "(SELECT *, o_totalprice > 250000 AS big, o_orderstatus = 'F' AS done, o_orderpriority < '3' AS urgent, year(o_orderdate)::VARCHAR AS y FROM orders)"
    parts = []
    for pop, cond in (("all", "true"), ("done", "done")):
        for dim, val in (("overall", "'all'"), ("o_orderpriority", "o_orderpriority"), ("y", "y")):
            parts.append(f"SELECT '{pop}' AS population, '{dim}' AS dimension, {val} AS value, count(*) AS n, count(*) FILTER (big) AS n_big, count(*) FILTER (big)::DOUBLE / count(*) AS rate_big, count(*) FILTER (urgent) AS n_urgent, count(*) FILTER (urgent)::DOUBLE / count(*) AS rate_urgent FROM {src} WHERE {cond} GROUP BY ALL")
    return rsql(" UNION ALL ".join(parts), "population, dimension, value, n, n_big, n_urgent", rate_big=6, rate_urgent=6)


@query("coverage_sets", _coverage_sql())
def coverage_sets(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", F.year("o_orderdate").alias("y"), (F.col("o_totalprice") > 250000).alias("big"),
                                         (F.col("o_orderstatus") == "F").alias("done"), (F.col("o_orderpriority") < "3").alias("urgent"))
    return rounded(P.coverage(o, ["o_orderpriority", "y"], ["big", "urgent"], "done"))


def _presence_sql() -> str:
    tmpl = "SELECT '{dim}' AS dimension, {val} AS value, count(*) AS n, count(quality) AS n_quality, count(quality)::DOUBLE / count(*) AS rate_quality, count(toxic) AS n_toxic, count(toxic)::DOUBLE / count(*) AS rate_toxic FROM " + DOCS_SQL + " GROUP BY ALL"
    parts = [tmpl.replace("{dim}", a).replace("{val}", b) for a, b in (("overall", "'all'"), ("lang", "lang"), ("source", "source"))]
    return rsql(" UNION ALL ".join(parts), "dimension, value, n, n_quality, n_toxic", rate_quality=6, rate_toxic=6)


@query("presence_by", _presence_sql())
def presence_by(spark, d):
    return rounded(P.presence_by(labelled_documents(spark, d), ["lang", "source"], ["quality", "toxic"]))


@query("presence_by_day", rsql("SELECT 'day' AS dimension, strftime(ts, '%Y-%m-%d') AS value, count(*) AS n, count(v) AS n_v, count(v)::DOUBLE / count(*) AS rate_v FROM (SELECT ts, CASE WHEN value > 20 THEN value END AS v FROM events) GROUP BY ALL UNION ALL SELECT 'overall', 'all', count(*), count(v), count(v)::DOUBLE / count(*) FROM (SELECT CASE WHEN value > 20 THEN value END AS v FROM events)", "dimension, value, n, n_v", rate_v=6))
def presence_by_day(spark, d):
    ev = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.when(F.col("value") > 20, F.col("value")).alias("v"))
    return rounded(P.presence_by(ev, ["day"], ["v"]))


@query("container_patterns", "SELECT 'props' AS \"column\", coalesce(array_to_string(list_sort(json_keys(props)), '|'), 'missing') AS pattern, count(*) AS n FROM events GROUP BY ALL")
def container_patterns(spark, d):
    ev = table(spark, d, "events").select(F.from_json("props", "map<string,string>").alias("props"))
    return P.container_patterns(ev, ["props"])


@query("composition", "SELECT o_orderpriority, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL")
def composition(spark, d):
    return P.composition(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


@query("composition_json", "SELECT o_orderpriority, '{' || string_agg('\"' || o_orderstatus || '\":' || n::VARCHAR, ',' ORDER BY o_orderstatus) || '}' AS composition, 0::BIGINT AS missing FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1")
def composition_json(spark, d):
    return P.composition_json(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


@query("group_coverage", "SELECT n_name, c_mktsegment, count(*) AS n_rows, count(DISTINCT c_custkey) AS n_ids FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def group_coverage(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return P.group_coverage(join_many_to_one(table(spark, d, "customer"), nation, "c_nationkey", "inner"), ["n_name", "c_mktsegment"], "c_custkey")


@query("confounded", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_tasks, count(*) AS n_rows, count(DISTINCT o_orderpriority) = 1 AS confounded FROM orders GROUP BY 1")
def confounded(spark, d):
    return P.confounded(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("status_counts", f"SELECT lang, quality::VARCHAR AS quality, count(*) AS n FROM {DOCS_SQL} GROUP BY ALL")
def status_counts(spark, d):
    docs = labelled_documents(spark, d).withColumn("quality", F.col("quality").cast("string"))
    return P.status_counts(docs, ["lang", "quality"])


FLAT_SQL = "(SELECT event_id, event_type, key AS path, json_extract_string(props, '$.' || key) AS value FROM (SELECT *, unnest(json_keys(props)) AS key FROM events))"


def flat_events(spark, d):
    return flatten_json(table(spark, d, "events"), "props", ["event_id", "event_type"])


@query("flatten_json", "SELECT event_id, event_type, path, 'bigint' AS kind, value, '' AS length FROM " + FLAT_SQL)
def flatten(spark, d):
    return flat_events(spark, d).withColumn("length", F.coalesce(F.col("length").cast("string"), F.lit("")))


@query("field_values", f"SELECT path, value, n, rank::INT AS rank, present::BIGINT AS present, \"unique\" FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, value) AS rank, sum(n) OVER (PARTITION BY path) AS present, count(*) OVER (PARTITION BY path) AS \"unique\" FROM (SELECT path, value, count(*) AS n FROM {FLAT_SQL} GROUP BY ALL)) WHERE rank <= 5")
def field_values(spark, d):
    return P.summarise_values(flat_events(spark, d).select("path", "value"))


@query("field_availability", f"SELECT path, event_type, count(DISTINCT event_id) AS n_documents FROM {FLAT_SQL} GROUP BY ALL")
def field_availability(spark, d):
    return P.availability(flat_events(spark, d), "path", "event_type", "event_id")


@query("check_expected", f"SELECT lang, path, count(*) AS checked, count(*) FILTER (value <> expected) AS mismatches FROM (SELECT lang, 'quality' AS path, quality::VARCHAR AS value, '1' AS expected FROM {DOCS_SQL} WHERE quality IS NOT NULL UNION ALL SELECT lang, 'toxic', toxic::VARCHAR, '0' FROM {DOCS_SQL} WHERE toxic IS NOT NULL) GROUP BY ALL")
def check_expected(spark, d):
    docs = labelled_documents(spark, d)
    long = docs.select("lang", F.inline(F.array(*[F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("value")) for c in ("quality", "toxic")])))
    spec = docs.select("lang").distinct().select("lang", F.inline(F.array(*[
        F.struct(F.lit(p).alias("path"), F.lit(v).alias("expected")) for p, v in (("quality", "1"), ("toxic", "0"))])))
    return P.check_expected(long.where("value is not null"), spec, "lang")


def turn_lengths(spark, d):
    return table(spark, d, "conversations").select("conv_id", "role", F.length("text").cast("bigint").alias("n"))


LEN_STATS = "{rep} * count(*) AS total_count, ({rep} * sum(n))::BIGINT AS total_length, ({rep} * sum(n * n))::BIGINT AS total_length_sq, avg(n) AS mean, min(n) AS min, max(n) AS max, stddev_pop(n) AS std, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.95) AS p95"
LEN_DIGITS = dict(mean=4, std=4, p50=4, p90=4, p95=4)


@query("length_stats", rsql("SELECT role, " + LEN_STATS.replace("{rep}", "3") + " FROM (SELECT role, length(text) AS n FROM conversations) GROUP BY 1", "role, total_count, total_length, total_length_sq, min, max", **LEN_DIGITS))
def length_stats(spark, d):
    return rounded(P.length_stats(turn_lengths(spark, d), "n", ["role"], 3), 4)


@query("length_stats_overall", rsql("SELECT " + LEN_STATS.replace("{rep}", "1") + " FROM (SELECT length(text) AS n FROM conversations)", "total_count, total_length, total_length_sq, min, max", **LEN_DIGITS))
def length_stats_overall(spark, d):
    return rounded(P.length_stats(turn_lengths(spark, d), "n"), 4)


def document_lengths(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("lang", "source", F.length("text").cast("bigint").alias("chars"), F.octet_length("text").cast("bigint").alias("bytes"))


DOC_LEN_SQL = "(SELECT lang, source, length(text) AS chars, octet_length(encode(text)) AS bytes FROM documents)"


@query("text_length_stats", rsql(each(["chars", "bytes"], "SELECT lang, '{c}' AS unit, count(*) AS n, avg({c}) AS mean, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.9) AS p90, quantile_cont({c}, 0.95) AS p95, max({c})::DOUBLE AS max, stddev_pop({c}) AS std, avg({c}::DOUBLE * {c}) AS second_moment, sqrt(avg({c}::DOUBLE * {c})) AS rms, stddev_pop({c}) / avg({c}) AS cv FROM " + DOC_LEN_SQL + " GROUP BY lang"), "lang, unit, n", mean=4, p50=4, p90=4, p95=4, max=4, std=4, second_moment=2, rms=4, cv=6))
def text_length_stats(spark, d):
    lengths = document_lengths(spark, d)
    q = quantile_columns(lengths, ["chars", "bytes"], {"p50": 0.5, "p90": 0.9, "p95": 0.95, "max": 1.0}, ["lang"]).withColumnRenamed("column", "unit")
    long = lengths.select("lang", F.inline(F.array(*[F.struct(F.lit(c).alias("unit"), F.col(c).alias("v")) for c in ("chars", "bytes")])))
    m = long.groupBy("lang", "unit").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    s = P.second_moments(long, "v", ["lang", "unit"])
    return rounded(q.join(m, ["lang", "unit"]).join(s, ["lang", "unit"]), 4, second_moment=2, cv=6)


@query("delta_report", rsql(f"SELECT count(*) AS n_rows, count(*) FILTER (x = 0) AS zero_delta, count(*) FILTER (x > 0) AS positive_delta, min(x)::DOUBLE AS min_delta, median(x) AS median_delta, max(x)::DOUBLE AS max_delta FROM (SELECT bytes - chars AS x FROM {DOC_LEN_SQL})", "n_rows, zero_delta, positive_delta", min_delta=4, median_delta=4, max_delta=4))
def delta_report(spark, d):
    return rounded(P.delta_report(document_lengths(spark, d), "chars", "bytes"), 4)


@query("delta_by_pair", rsql(f"SELECT lang, source, avg(bytes - chars) AS mean_delta, avg(bytes::DOUBLE / nullif(chars, 0)) AS mean_ratio FROM {DOC_LEN_SQL} GROUP BY ALL", "lang, source", mean_delta=4, mean_ratio=6))
def delta_by_pair(spark, d):
    return rounded(P.delta_by_pair(document_lengths(spark, d), "chars", "bytes", ["lang", "source"]), 4, mean_ratio=6)


LEVELS = {"L0": ["lang"], "L1": ["lang", "quality"], "L2": ["lang", "quality", "toxic"]}


def _feature_coverage_sql() -> str:
    parts = []
    for level, feats in LEVELS.items():
        for f in feats:
            na = "lang <> 'en'" if f == "toxic" else "false"
            parts.append(f"SELECT '{level}' AS level, '{f}' AS feature, count(*) AS n_rows, count(DISTINCT source) AS n_groups, count(*) - count({f}) AS n_missing, count(DISTINCT {f}) AS n_unique, count(*) FILTER ({na}) AS n_structural_na, count(*) FILTER ({f} IS NULL AND NOT ({na})) AS n_unknown FROM {DOCS_SQL}")
    return " UNION ALL ".join(parts)


@query("feature_coverage", _feature_coverage_sql())
def feature_coverage(spark, d):
    return P.feature_coverage(labelled_documents(spark, d), LEVELS, "source", {"toxic": F.col("lang") != "en"})


@query("repeat_summary", rsql("SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, max(value) AS max FROM events GROUP BY 1", "event_type, n", mean=6, std=6, max=6))
def repeat_summary(spark, d):
    return rounded(P.repeat_summary(table(spark, d, "events"), ["event_type"], "value"))


# Example role rules for the order table.
ROLE_EXACT = {"o_orderkey": ("identifier_risk", False), "o_totalprice": ("target", False)}
ROLE_PREFIX = {"o_order": ("pre_known", True)}
ROLE_FRAGMENT = {"cust": ("diagnostic", False)}


@query("classify_fields", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{r}' AS role, {a} AS allowed, count({c}) AS non_null FROM orders" for c, r, a in (
    ("o_orderkey", "identifier_risk", "false"), ("o_custkey", "diagnostic", "false"), ("o_orderstatus", "pre_known", "true"),
    ("o_totalprice", "target", "false"), ("o_orderdate", "pre_known", "true"), ("o_orderpriority", "pre_known", "true"))))
def classify_fields(spark, d):
    return P.classify_fields(table(spark, d, "orders"), ROLE_EXACT, ROLE_PREFIX, ROLE_FRAGMENT)


# Example role contract.
CONTRACT = {"x_quantity": "X_workload", "x_discount": "X_protocol", "x_size": "X_hardware"}


@query("role_manifest", "WITH t AS (SELECT l_quantity AS x_quantity, l_discount AS x_discount, l_extendedprice AS y_price, p_size AS x_size FROM lineitem LEFT JOIN part ON p_partkey = l_partkey) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{r}' AS role, {a} AS allowed, '{t}' AS dtype, count({c}) AS non_null FROM t" for c, r, a, t in (
        ("x_quantity", "X_workload", "true", "double"), ("x_discount", "X_protocol", "true", "double"), ("y_price", "diagnostic", "false", "double"), ("x_size", "X_hardware", "true", "int"))))
def role_manifest(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("x_size"))
    lines = table(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").alias("x_quantity"), F.col("l_discount").alias("x_discount"), F.col("l_extendedprice").alias("y_price"))
    return P.role_manifest(join_many_to_one(lines, part, "l_partkey").drop("l_partkey"), CONTRACT, allowed_roles=list(CONTRACT.values()))


@query("prefix_columns", "SELECT o_orderstatus, count(DISTINCT o_orderpriority) AS n_priorities FROM (SELECT o_orderstatus, o_orderpriority FROM orders) GROUP BY 1")
def prefix_columns(spark, d):
    orders = table(spark, d, "orders")
    return orders.select(*cols_with_prefix(orders, "o_orders", "o_orderp")).groupBy("o_orderstatus").agg(F.countDistinct("o_orderpriority").alias("n_priorities"))


@query("candidate_keys", "SELECT 'order' AS name, count(*) AS n_keys, max(n) AS largest FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey) "
       "UNION ALL SELECT 'customer_status', count(*), max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus)")
def candidate_keys(spark, d):
    """How well each candidate key, less the columns the table lacks, tells rows apart."""
    orders = table(spark, d, "orders")
    keys = P.candidate_keys(orders, {"order": ["o_orderkey", "o_linenumber"], "customer_status": ["o_custkey", "o_orderstatus"]})
    parts = [orders.groupBy(*cols).agg(F.count("*").alias("n")).agg(F.count("*").alias("n_keys"), F.max("n").alias("largest")).select(F.lit(name).alias("name"), "n_keys", "largest") for name, cols in keys.items()]
    return parts[0].unionByName(parts[1])
