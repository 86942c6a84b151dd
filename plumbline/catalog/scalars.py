"""Key, text, JSON, flag and proxy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import base as B
from plumbline.catalog.profiling import DOCS_SQL, labelled_documents
from plumbline.catalog.registry import query, rounded, rsql, table
from plumbline.functions import keys as K
from plumbline.functions import numeric as N
from plumbline.functions import predicates as R
from plumbline.functions import proxies as X
from plumbline.functions import text as T
from plumbline.functions.documents import canonical_lineage, canonicalise, flatten_json_fixed, has_key
from plumbline.operators.gates import verify_digests
from plumbline.operators.joins import enrich, join_many_to_one
from plumbline.operators.ordering import quantile_columns
from plumbline.sources.readers import dim

# ---- keys and digests ------------------------------------------------------------------------


@query("run_key", "SELECT o_orderkey, to_json({o_orderpriority: o_orderpriority, o_orderstatus: o_orderstatus, o_custkey: o_custkey})::VARCHAR AS run_key FROM orders")
def run_key(spark, d):
    o = table(spark, d, "orders")
    return K.with_run_key(o, ["o_orderpriority", "o_orderstatus", "o_custkey"]).select("o_orderkey", "run_key")


@query("canonical_json", "SELECT doc_id, to_json({doc_id: d.doc_id, lang: lang, quality: quality, source: source})::VARCHAR AS doc FROM " + DOCS_SQL + " d")
def canonical_json(spark, d):
    return labelled_documents(spark, d).select("doc_id", K.canonical_json(["source", "quality", "lang", "doc_id"]).alias("doc"))


DIGEST = "sum(('0x' || substr(md5(to_json({o_custkey: o_custkey::VARCHAR, o_orderkey: o_orderkey::VARCHAR, o_orderpriority: o_orderpriority, o_totalprice: o_totalprice::VARCHAR})::VARCHAR), 1, 15))::BIGINT::HUGEINT)::VARCHAR"
DIGEST_COLS = ["o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"]


@query("table_digest", f"SELECT count(*) AS n_rows, {DIGEST} AS digest, 'o_custkey:bigint,o_orderkey:bigint,o_orderpriority:string,o_totalprice:double' AS schema FROM orders")
def table_digest(spark, d):
    return K.table_digest(table(spark, d, "orders"), DIGEST_COLS)


@query("verify_digest", f"WITH g AS (SELECT o_orderstatus, count(*) AS n_rows, {DIGEST} AS digest FROM orders GROUP BY 1) SELECT o_orderstatus, digest, n_rows, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'verified' ELSE 'unverified' END AS status FROM g")
def verify_digest(spark, d):
    o = table(spark, d, "orders")
    now = K.grouped_digest(o, ["o_orderstatus"], DIGEST_COLS)
    frozen = K.grouped_digest(o.where("o_orderstatus <> 'P'"), ["o_orderstatus"], DIGEST_COLS)
    return verify_digests(now, frozen, ["o_orderstatus"])


@query("fingerprints", "SELECT o_orderpriority, o_orderstatus, o_orderpriority || '__' || o_orderstatus AS experiment_id, sha256(to_json({bundle: 'B1', o_orderpriority: o_orderpriority, o_orderstatus: o_orderstatus})::VARCHAR) AS fingerprint, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders)")
def fingerprints(spark, d):
    cells = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus").distinct()
    return cells.withColumns({
        "experiment_id": K.experiment_id("o_orderpriority", "o_orderstatus"),
        "fingerprint": K.fingerprint(F.lit("B1").alias("bundle"), F.col("o_orderpriority"), F.col("o_orderstatus")),
        "slug": K.slug(F.col("o_orderpriority"))})


# ---- guarded arithmetic ----------------------------------------------------------------------

@query("safe_ratios", rsql("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax / nullif(l_discount, 0) AS ratio, abs(l_tax - l_discount) / greatest(abs(l_tax), abs(l_discount), 1e-12) AS relative_error FROM lineitem", "l_orderkey, l_linenumber, l_partkey, l_suppkey", ratio=6, relative_error=6))
def safe_ratios(spark, d):
    return rounded(table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.safe_ratio(F.col("l_tax"), F.col("l_discount")).alias("ratio"),
        N.relative_error(F.col("l_tax"), F.col("l_discount")).alias("relative_error")))


@query("transforms", rsql(f"WITH {B.RUNS_SQL} SELECT run_key, ln(1 + y) AS t_log, y / units AS t_unit, greatest(exp(ln(1 + y / units)) - 1, 0) * units AS restored FROM runs", "run_key", t_log=6, t_unit=6, restored=5))
def transforms(spark, d):
    y, u = F.col("y"), F.col("units")
    return rounded(B.runs(spark, d).select("run_key", N.transform_target(y, "log1p").alias("t_log"), N.transform_target(y, "raw", u).alias("t_unit"),
                                           N.restore_target(N.transform_target(y, "log1p", u), "log1p", u).alias("restored")), 6, restored=5)


@query("weights", rsql(f"WITH {B.FOLDED_SQL}, m AS (SELECT fold, median(y) AS med FROM folded GROUP BY 1) SELECT run_key, fold, least(greatest(sqrt(y / med), 0.5), 2.0) AS weight FROM folded JOIN m USING (fold)", "run_key, fold", weight=6))
def weights(spark, d):
    return rounded(N.high_value_weights(B.folded_runs(spark, d), "y", ["fold"]).select("run_key", "fold", "weight"))


# ---- flags and bins --------------------------------------------------------------------------

@query("bins", "SELECT p_partkey, CASE WHEN p_size <= 20 THEN 'small' WHEN p_size <= 40 THEN 'medium' ELSE 'large' END AS scale, CASE WHEN p_retailprice < 950 THEN 'low' WHEN p_retailprice < 1000 THEN 'mid' ELSE 'high' END AS price_band FROM part")
def bins(spark, d):
    inf = float("inf")
    return table(spark, d, "part").select(
        "p_partkey", R.bin_scale(F.col("p_size"), [20, 40], ["small", "medium", "large"]).alias("scale"),
        R.cut(F.col("p_retailprice"), [-inf, 950.0, 1000.0, inf], ["low", "mid", "high"]).alias("price_band"))


@query("structural_zero", f"SELECT doc_id, (CASE WHEN lang = 'en' THEN toxic ELSE 0 END)::VARCHAR AS toxic, lang = 'en' AS toxic_applicable, lang = 'en' AND toxic IS NULL AS toxic_unknown FROM {DOCS_SQL}")
def structural_zero(spark, d):
    out = R.structural_zero(labelled_documents(spark, d), "toxic", F.col("lang") == "en")
    return out.select("doc_id", F.col("toxic").cast("string").alias("toxic"), "toxic_applicable", "toxic_unknown")


ELIG_SQL = f"SELECT doc_id, lang, source, n_chars, quality, toxic, quality IS NOT NULL AS eligible_base, quality IS NOT NULL AND quality = 1 AND toxic >= 0 AS eligible_full, quality IS NOT NULL AND quality = 1 AND toxic >= 0 AND n_chars > 500 AS eligible_physics FROM {DOCS_SQL}"


def eligible_documents(spark, d):
    return R.eligibility(labelled_documents(spark, d), {
        "eligible_base": R.all_present(["quality"]), "eligible_full": (F.col("quality") == 1) & R.finite_nonneg(["toxic"]),
        "eligible_physics": F.col("n_chars") > 500})


@query("eligibility", f"SELECT doc_id, eligible_base, eligible_full, eligible_physics FROM ({ELIG_SQL})")
def eligibility(spark, d):
    return eligible_documents(spark, d).select("doc_id", "eligible_base", "eligible_full", "eligible_physics")


@query("reasons", f"SELECT doc_id, nullif(concat_ws(';', CASE WHEN quality IS NULL THEN 'labels_missing' END, CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN n_chars <= 500 THEN 'too_short' END), '') AS reasons FROM {DOCS_SQL}")
def reasons(spark, d):
    return labelled_documents(spark, d).select("doc_id", R.reasons([
        ("labels_missing", F.col("quality").isNull()), ("low_quality", F.col("quality") == 0), ("toxic", F.col("toxic") == 1),
        ("too_short", F.col("n_chars") <= 500)]).alias("reasons"))


@query("above_quantile", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.9) FROM orders)")
def above_quantile(spark, d):
    return R.above_quantile(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.9)


# ---- text and paths --------------------------------------------------------------------------

PATH_SQL = "lower(replace(regexp_replace(url, '[?#].*$', ''), '\\', '/'))"


@query("path_allowed", f"SELECT page_id, p LIKE 'https://%' AND NOT list_contains(string_split(p, '/'), '..') AND p NOT LIKE '%spam%' AND p NOT LIKE '%.html' AS allowed FROM (SELECT page_id, {PATH_SQL} AS p FROM pages)")
def path_allowed(spark, d):
    path = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, d, "pages").select("page_id", R.path_allowed(path, "https://", deny=["spam"], deny_suffix=[".html"]).alias("allowed"))


@query("clean_text", "SELECT doc_id, trim(regexp_replace(text, '[^a-zA-Z0-9 ]+', '', 'g')) AS cleaned FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text"), "[^a-zA-Z0-9 ]+").alias("cleaned"))


@query("extract_hits", "SELECT page_id, hit, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href=\"/([^\"]*)\"', 1)) AS hit FROM pages) GROUP BY ALL")
def extract_hits(spark, d):
    hits = T.extract_hits(table(spark, d, "pages"), "html", '<li><a href="/([^"]*)"', ["page_id"])
    return hits.groupBy("page_id", "hit").agg(F.count("*").alias("n"))


@query("evidence", "WITH h AS (SELECT domain, lower(trim(lang)) AS n FROM (SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS domain, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages)) SELECT domain, count(DISTINCT nullif(n, '')) AS n_names, CASE WHEN count(DISTINCT nullif(n, '')) = 1 THEN 'resolved' WHEN count(DISTINCT nullif(n, '')) > 1 THEN 'conflict' ELSE 'unresolved' END AS status, CASE WHEN count(DISTINCT nullif(n, '')) = 1 THEN min(nullif(n, '')) END AS resolved_name FROM h GROUP BY 1")
def evidence(spark, d):
    pages = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("domain"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))
    return T.resolve_identity(pages, "domain", "lang")


# Shapes of personal data that occur in the test texts.
SCAN = {"email": r"[A-Za-z0-9._]+@[A-Za-z0-9-]+\.[a-z]{2,}", "phone": r"[0-9]{3}[-. ][0-9]{3,4}[-. ][0-9]{4}", **{
    "model_hub_token": r"\bhf_[A-Za-z0-9]{20,}\b", "cloud_access_key": r"\bAKIA[A-Z0-9]{16}\b"}}


@query("secret_scan", " UNION ALL ".join(f"SELECT doc_id, '{n}' AS category FROM documents WHERE regexp_matches(text, '{p}')" for n, p in SCAN.items()))
def secret_scan(spark, d):
    return T.secret_scan(table(spark, d, "documents"), "text", ["doc_id"], SCAN)


@query("secret_scan_counts", " UNION ALL ".join(f"SELECT '{n}' AS category, count(*) FILTER (regexp_matches(text, '{p}')) AS n FROM documents" for n, p in T.SECRET_PATTERNS.items()))
def secret_scan_counts(spark, d):
    docs = table(spark, d, "documents").agg(*[F.count_if(F.col("text").rlike(p)).alias(n) for n, p in T.SECRET_PATTERNS.items()])
    return docs.select(F.inline(F.array(*[F.struct(F.lit(n).alias("category"), F.col(n).alias("n")) for n in T.SECRET_PATTERNS])))


@query("count_symbol", "SELECT doc_id, (length(text) - length(replace(text, '.', '')))::INT AS dots, (length(text) - length(replace(text, 'th', '')))::INT // 2 AS ths FROM documents")
def count_symbol(spark, d):
    return table(spark, d, "documents").select("doc_id", T.count_symbol(F.col("text"), ".").alias("dots"), T.count_symbol(F.col("text"), "th").alias("ths"))


# ---- conversations ---------------------------------------------------------------------------

@query("turn_roles", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, length(text) AS n_chars FROM conversations WHERE role <> 'system'")
def turn_roles(spark, d):
    turns = table(spark, d, "conversations").where("role <> 'system'")
    return turns.select("conv_id", "turn", T.turn_role(F.col("turn")).alias("role"), F.length("text").cast("bigint").alias("n_chars"))


@query("messages", """SELECT doc_id, len(parts)::INT + 1 AS n_messages, md5('system: answer in ' || lang || chr(10) || array_to_string(list_transform(range(1, len(parts) + 1), lambda i: (CASE WHEN i % 2 = 1 THEN 'user: ' ELSE 'assistant: ' END) || parts[i]), chr(10))) AS digest
FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents)""")
def messages(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.split("text", "\n").alias("parts"))
    chat = docs.withColumn("chat", T.to_messages("parts", F.concat(F.lit("answer in "), F.col("lang"))))
    lines = F.array_join(F.transform("chat", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return chat.select("doc_id", F.size("chat").alias("n_messages"), F.md5(lines).alias("digest"))


@query("prompt_templates", "SELECT item_id, md5('<|fim_prefix|>' || substr(text, 1, 40) || '<|fim_suffix|>' || substr(text, 41) || '<|fim_middle|>') AS digest FROM benchmark UNION ALL SELECT doc_id, md5('<|fim_prefix|>' || substr(text, 1, 40) || '<|fim_suffix|>' || substr(text, 41) || '<|fim_middle|>') FROM documents")
def prompt_templates(spark, d):
    items = table(spark, d, "benchmark").unionByName(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text"))
    rest = F.substring(F.col("text"), F.lit(41), F.length("text"))
    return items.select("item_id", F.md5(T.fim_prompt(F.substring("text", 1, 40), rest)).alias("digest"))


CHOICES = "[trim(lang), trim(source), 'none', trim(doc_id::VARCHAR)]"


@query("choice_prompts", f"""SELECT doc_id, 'What is the correct answer to the following question: ' || source || chr(10) || chr(10) || 'Choices:' || array_to_string(list_transform(range(1, 5), lambda i: chr(10) || '(' || substr('ABCD', i, 1) || ') ' || s[i].c), '') AS prompt,
'(' || substr('ABCD', list_position(list_transform(s, lambda x: x.c), doc_id::VARCHAR)::INT, 1) || ') ' || doc_id::VARCHAR AS answer
FROM (SELECT doc_id, lang, source, list_sort(list_transform({CHOICES}, lambda c: {{h: md5('5|' || doc_id::VARCHAR || '|' || c), c: c}})) AS s FROM documents)""")
def choice_prompts(spark, d):
    docs = table(spark, d, "documents")
    prompt, answer = T.choice_prompt(F.col("source"), [F.col("lang"), F.col("source"), F.lit("none")], F.col("doc_id").cast("string"), 5, F.col("doc_id"))
    return docs.select("doc_id", prompt.alias("prompt"), answer.alias("answer"))


@query("distinct_inputs", "SELECT lang, count(*) AS n_requests, count(DISTINCT text) AS n_distinct FROM documents GROUP BY 1")
def distinct_inputs(spark, d):
    return T.distinct_inputs(table(spark, d, "documents"), F.col("text"), ["lang"])


# ---- JSON documents --------------------------------------------------------------------------

@query("flatten_fixed", "SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def flatten_fixed(spark, d):
    return flatten_json_fixed(table(spark, d, "events"), "props", ["event_id"], {"k": "$.k", "j": "$.j"})


@query("key_present", "SELECT event_type, count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS has_k, count(*) FILTER (json_extract_string(props, '$.timeline') IS NOT NULL) AS has_timeline FROM events GROUP BY 1")
def key_present(spark, d):
    ev = table(spark, d, "events")
    return ev.groupBy("event_type").agg(F.count_if(has_key(F.col("props"), "k")).alias("has_k"), F.count_if(has_key(F.col("props"), "timeline")).alias("has_timeline"))


RULES = {"count": ["$.count", "$.n", "$.k"], "width": ["$.width"]}


@query("canonicalise", "SELECT event_id, json_extract_string(props, '$.k') AS count, NULL::VARCHAR AS width FROM events")
def canonical(spark, d):
    return canonicalise(table(spark, d, "events"), "props", "event_id", RULES)


@query("canonical_lineage", "SELECT event_id, 'count' AS field, '$.k' AS source_field, json_extract_string(props, '$.k') AS raw_value, 'text to number' AS transform, 'available' AS status, NULL::VARCHAR AS reason FROM events UNION ALL SELECT event_id, 'width', NULL, NULL, 'identity', 'missing', 'source field absent' FROM events")
def lineage(spark, d):
    return canonical_lineage(table(spark, d, "events"), "props", "event_id", RULES, {"count": "text to number"})


# ---- proxies ---------------------------------------------------------------------------------

# Example parameter table, keyed by language, and unit profiles keyed by role.
MODELS = {
    "en": dict(layers=32, hidden=4096, heads=32, kv_heads=8, head_dim=128, dense_width=14336, dense_layers=32, moe_layers=0, moe_width=None, active_experts=None, shared_experts=None, shared_width=None, params=8.0e9, precision_bits=16, element_bits=16, gated=True, attention_variant="gqa"),
    "de": dict(layers=48, hidden=2048, heads=32, kv_heads=4, head_dim=128, dense_width=6144, dense_layers=2, moe_layers=46, moe_width=768, active_experts=8, shared_experts=1, shared_width=1024, params=3.0e10, precision_bits=8, element_bits=16, gated=True, attention_variant="gqa"),
    "fr": dict(layers=61, hidden=7168, heads=128, kv_heads=128, head_dim=192, dense_width=18432, dense_layers=3, moe_layers=58, moe_width=2048, active_experts=8, shared_experts=1, shared_width=2048, params=6.7e11, precision_bits=8, element_bits=16, gated=True, attention_variant="mla"),
    "es": dict(layers=24, hidden=2880, heads=64, kv_heads=8, head_dim=64, dense_width=2880, dense_layers=24, moe_layers=0, moe_width=None, active_experts=None, shared_experts=None, shared_width=None, params=2.0e10, precision_bits=4, element_bits=None, gated=False, attention_variant="mha"),
}


def _model_values() -> str:
    def lit(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(float(v)) + "::DOUBLE"
    names = list(MODELS["en"])
    rows = ", ".join(f"('{k}', {', '.join(lit(a[n]) for n in names)})" for k, a in MODELS.items())
    return f"(VALUES {rows}) m(lang, {', '.join(names)})"


REPEATS, CAP, UNITS, DP = 3, 512, 4, 2
PHYS = """WITH lens AS (SELECT lang, source, count(*)::DOUBLE AS n, sum(l) AS s1, sum(l * l) AS s2, max(l) AS top FROM (SELECT lang, source, length(text)::DOUBLE AS l FROM documents) GROUP BY ALL),
j AS (SELECT *, CASE WHEN attention_variant = 'mla' THEN 'unsupported' WHEN element_bits IS NULL THEN 'missing' ELSE 'available' END AS physics_status FROM lens JOIN {models} USING (lang)),
v AS (SELECT *, {rep} * layers * 4 * s1 * hidden * head_dim * (heads + kv_heads) AS prefill_projection, {rep} * layers * 4 * heads * head_dim * s2 AS prefill_attention,
 CASE WHEN gated THEN 6 ELSE 4 END * hidden * (dense_layers * dense_width + coalesce(moe_layers * (moe_width * active_experts + coalesce(shared_experts * shared_width, 0)), 0)) AS mlp1,
 layers * 4 * hidden * head_dim * (heads + kv_heads) AS proj1, 2 * layers * kv_heads * head_dim * element_bits / 8 AS kv1 FROM j),
w AS (SELECT *, {rep} * s1 * mlp1 AS prefill_mlp, {rep} * (n * {cap} * (proj1 + mlp1) + layers * 4 * heads * head_dim * ({cap} * s1 + n * {cap} * ({cap} + 1) / 2)) AS decode_upper_bound,
 {rep} * kv1 * s1 AS kv_prefill_sum_bytes, kv1 * top AS kv_prefill_max_bytes, {rep} * kv1 * (s1 + n * {cap}) AS kv_cap_sum_bytes, params * precision_bits / 8 AS weight_bytes_total FROM v)
SELECT lang, source, physics_status, """.format(models=_model_values(), rep=REPEATS, cap=CAP) + ", ".join(
    f"CASE WHEN physics_status = 'available' THEN {e} END AS {n}" for n, e in (
        ("prefill_projection", "prefill_projection / 1e12"), ("prefill_attention", "prefill_attention / 1e12"), ("prefill_mlp", "prefill_mlp / 1e12"),
        ("prefill_total_per_unit", f"(prefill_projection + prefill_attention + prefill_mlp) / {UNITS} / 1e12"), ("decode_upper_bound", "decode_upper_bound / 1e12"),
        ("kv_prefill_sum_bytes", "kv_prefill_sum_bytes / 1e9"), ("kv_prefill_max_bytes", "kv_prefill_max_bytes / 1e9"), ("kv_cap_sum_bytes", "kv_cap_sum_bytes / 1e9"),
        ("weight_bytes_per_unit", f"weight_bytes_total * {DP} / {UNITS} / 1e9"))) + " FROM w"
PHYS_COLS = ["prefill_projection", "prefill_attention", "prefill_mlp", "prefill_total_per_unit", "decode_upper_bound", "kv_prefill_sum_bytes",
             "kv_prefill_max_bytes", "kv_cap_sum_bytes", "weight_bytes_per_unit"]


def physics_runs(spark, d):
    docs = table(spark, d, "documents").select("lang", "source", F.length("text").alias("l"))
    moments = X.length_moments(docs, ["lang", "source"], "l")
    return enrich(moments, dim(spark, MODELS, "lang"), "lang").withColumns(
        {"repeats": F.lit(REPEATS), "output_cap": F.lit(CAP), "units": F.lit(UNITS), "data_parallel": F.lit(DP)})


@query("proxies", rsql(PHYS, "lang, source, physics_status", **{c: 4 for c in PHYS_COLS}))
def proxies(spark, d):
    out = X.physics_features(physics_runs(spark, d))
    scale = {c: (1e9 if "bytes" in c else 1e12) for c in PHYS_COLS}
    return rounded(out.select("lang", "source", "physics_status", *[(F.col(c) / scale[c]).alias(c) for c in PHYS_COLS]), 4)


COMPACT_SQL = f"""WITH s AS (SELECT lang, avg(l) AS mean, avg(l * l) AS m2, quantile_cont(l, 0.95) AS p95, max(l) AS top FROM (SELECT lang, length(text)::DOUBLE AS l FROM documents) GROUP BY 1),
j AS (SELECT *, 4 * hidden * head_dim * (heads + kv_heads) * layers AS proj, 2 * 3 * hidden * dense_width * 1 * layers AS mlp, 4 * layers * heads * head_dim AS att, 2 * layers * kv_heads * head_dim * 2 AS kv FROM s JOIN {_model_values()} USING (lang))
SELECT lang, proj * mean / 1e9 AS prefill_projection_per_request, att * m2 / 1e9 AS prefill_attention_per_request, mlp * mean / 1e9 AS prefill_mlp_per_request, kv * mean / 1e9 AS kv_mean_request_bytes, kv * p95 / 1e9 AS kv_p95_request_bytes, kv * top / 1e9 AS kv_max_request_bytes, (proj + mlp + att * (mean + 1)) / 1e9 AS decode_one_token_mean_context, (proj * mean + att * m2 + mlp * mean) / 1e9 AS prefill_total_per_request FROM j"""
COMPACT_COLS = ["prefill_projection_per_request", "prefill_attention_per_request", "prefill_mlp_per_request", "kv_mean_request_bytes", "kv_p95_request_bytes",
                "kv_max_request_bytes", "decode_one_token_mean_context", "prefill_total_per_request"]


@query("compact_proxies", rsql(COMPACT_SQL, "lang", **{c: 4 for c in COMPACT_COLS}))
def compact_proxies(spark, d):
    docs = table(spark, d, "documents").select("lang", F.length("text").cast("double").alias("l"))
    q = quantile_columns(docs, ["l"], {"p95": 0.95, "top": 1.0}, ["lang"]).drop("column", "n")
    stats = docs.groupBy("lang").agg(F.avg("l").alias("mean"), F.avg(F.col("l") * F.col("l")).alias("m2")).join(q, "lang")
    rows = enrich(stats, dim(spark, MODELS, "lang"), "lang")
    c = X.c
    cols = X.compact_physics(c("mean"), c("m2"), c("p95"), c("top"), layers=c("layers"), hidden=c("hidden"), heads=c("heads"), kv_heads=c("kv_heads"),
                             head_dim=c("head_dim"), width=c("dense_width"), active_experts=F.lit(1.0), mlp_terms=F.lit(3.0), element_bytes=F.lit(2.0))
    return rounded(rows.select("lang", *[(v / 1e9).alias(k) for k, v in cols.items()]), 4)


DEPLOY = "n_lines % 2 = 0 AND n_lines >= 1"


@query("deployment_ratios", rsql(f"WITH {B.RUNS_SQL} SELECT run_key, CASE WHEN {DEPLOY} THEN n_lines / 2.0 END AS units_per_replica, CASE WHEN {DEPLOY} THEN qty / n_lines END AS max_seqs_per_unit, CASE WHEN {DEPLOY} THEN 16e9 / (n_lines / 2.0) / 80e9 END AS weight_capacity_ratio FROM runs", "run_key", units_per_replica=4, max_seqs_per_unit=4, weight_capacity_ratio=6))
def deployment_ratios(spark, d):
    cols = X.deployment_ratios(F.col("n_lines"), F.lit(2), F.col("qty"), F.lit(16e9), F.lit(8e9), F.lit(80e9))
    return rounded(B.runs(spark, d).select("run_key", *[cols[c].alias(c) for c in ("units_per_replica", "max_seqs_per_unit", "weight_capacity_ratio")]), 4, weight_capacity_ratio=6)


# Example unit profiles keyed by order status.
UNIT_PROFILES = {
    "F": {"peak16": 989.5, "peak8": 1979.0, "peak4": None, "bandwidth_gb": 3350.0, "capacity_gb": 80.0, "rated_power": 700.0},
    "O": {"peak16": 2250.0, "peak8": 4500.0, "peak4": 9000.0, "bandwidth_gb": 8000.0, "capacity_gb": 180.0, "rated_power": 1000.0},
    "P": {"peak16": 312.0, "peak8": None, "peak4": None, "bandwidth_gb": 2039.0, "capacity_gb": 80.0, "rated_power": 400.0}}
PRECISION_PEAK = {"bfloat16": "peak16", "fp8": "peak8", "mxfp4": "peak4"}
HW_SQL = f"""WITH {B.RUNS_SQL}, p AS (SELECT * FROM (VALUES ('F', 989.5, 1979.0, NULL, 3350.0, 80.0, 700.0), ('O', 2250.0, 4500.0, 9000.0, 8000.0, 180.0, 1000.0), ('P', 312.0, NULL, NULL, 2039.0, 80.0, 400.0)) v(hw, peak16, peak8, peak4, bw, cap, rated)),
j AS (SELECT run_key, units, y, qty, CASE substr(task, 1, 1) WHEN '1' THEN peak16 WHEN '2' THEN peak16 WHEN '3' THEN peak8 WHEN '4' THEN peak4 END::DOUBLE AS peak, bw::DOUBLE AS bw, cap::DOUBLE AS cap, rated::DOUBLE AS rated, CASE WHEN qty > 0 THEN qty * 1e13 END AS work FROM runs JOIN p USING (hw)),
t AS (SELECT *, work / (peak * 1e12 * units) AS compute_time, (20e9 + y * 98765.4321::DOUBLE / units) / (bw * 1e9) AS memory_time FROM j)
SELECT run_key, compute_time, memory_time, 20e9 / (cap * 1e9) AS weight_capacity_ratio, y * 98765.4321::DOUBLE / units / (cap * 1e9) AS kv_capacity_ratio_mean, y * 198765.4321::DOUBLE / units / (cap * 1e9) AS kv_capacity_ratio_max, compute_time / memory_time AS pressure_ratio, rated * units AS aggregate_rated_power, y * 0.0123456789::DOUBLE / (rated * units) AS power_fraction FROM t"""
HW_COLS = ["compute_time", "memory_time", "weight_capacity_ratio", "kv_capacity_ratio_mean", "kv_capacity_ratio_max", "pressure_ratio", "aggregate_rated_power", "power_fraction"]


@query("hardware_proxies", rsql(HW_SQL, "run_key", **{c: 9 for c in HW_COLS}))
def hardware_proxies(spark, d):
    runs = enrich(B.runs(spark, d), dim(spark, UNIT_PROFILES, "hw"), "hw")
    precision = R.map_values(F.substring("task", 1, 1), {"1": "bfloat16", "2": "BFLOAT16", "3": "fp8", "4": "mxfp4", "5": "int3"})
    rows = runs.withColumns({
        "precision": precision, "parallel_units": F.lit(None).cast("double"), "tensor_parallel": F.col("units"), "work": F.col("qty") * 1e13,
        "weight_bytes_per_unit": F.lit(20e9), "kv_mean_bytes": F.col("y") * 98765.4321, "kv_max_bytes": F.col("y") * 198765.4321, "observed_power": F.col("y") * 0.0123456789})
    return rounded(X.hardware_proxies(rows, PRECISION_PEAK).select("run_key", *HW_COLS), 9)


@query("architecture_ratios", rsql(f"SELECT doc_id, dense_width / hidden AS expansion_ratio, moe_layers / layers AS moe_layer_fraction, dense_layers / layers AS dense_layer_fraction, params / layers / 1e9 AS params_per_layer, attention_variant = 'gqa' AS grouped_ratio_applicable, CASE WHEN attention_variant = 'gqa' THEN heads / kv_heads ELSE 0 END AS grouped_ratio FROM documents JOIN {_model_values()} USING (lang)", "doc_id, grouped_ratio_applicable", expansion_ratio=6, moe_layer_fraction=6, dense_layer_fraction=6, params_per_layer=6, grouped_ratio=6))
def architecture_ratios(spark, d):
    rows = join_many_to_one(table(spark, d, "documents").select("doc_id", "lang"), dim(spark, MODELS, "lang"), "lang", "inner")
    c = X.c
    cols = X.architecture_ratios(c("hidden"), c("dense_width"), c("layers"), c("moe_layers"), c("dense_layers"), c("params") / 1e9, c("params") / 1e9, c("heads"), c("kv_heads"), F.col("attention_variant") == "gqa")
    keep = ["expansion_ratio", "moe_layer_fraction", "dense_layer_fraction", "params_per_layer", "grouped_ratio_applicable", "grouped_ratio"]
    return rounded(rows.select("doc_id", *[cols[k].alias(k) for k in keep]))
