"""Hand-computed rows for audits, scalars, proxies, metrics and gates."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import documents as D
from plumbline.functions import keys as K
from plumbline.functions import numeric as N
from plumbline.functions import predicates as R
from plumbline.functions import proxies as X
from plumbline.functions import text as T
from plumbline.operators import evaluation as E
from plumbline.operators import gates as G
from plumbline.operators import profile as P
from plumbline.operators import ranking as W
from plumbline.plans import matrix as M
from plumbline.plans.bundles import resolve_bundles


def one(df):
    return df.first().asDict()


def value(spark, col, *pairs):
    """One row of literals, one expression."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in pairs]).select(col.alias("v")).first()["v"]


# ---- audit -----------------------------------------------------------------------------------

def test_product_and_ratio_identity(spark):
    df = spark.createDataFrame([(0, 6.0, 2.0, 3.0), (1, 5.0, 2.0, 3.0), (2, None, 2.0, 3.0)], "i int, o double, a double, b double")
    got = one(P.identity_check(df, F.col("o"), F.col("a") * F.col("b")))
    assert (got["checked"], got["failed"]) == (2, 1) and got["max_relative_error"] == pytest.approx(1 / 6)
    assert [r["i"] for r in P.identity_failures(df, F.col("o"), F.col("a") * F.col("b"), ["i"]).collect()] == [1]
    ratio = spark.createDataFrame([(100.0, 20.0, 5.0), (100.0, 20.0, 4.0), (1.0, 0.0, 4.0)], "e double, d double, p double")
    got = one(P.identity_check(ratio, F.col("p"), F.try_divide("e", "d")))
    assert (got["checked"], got["failed"]) == (2, 1)


def test_order_check_allows_ties(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 3.0, 2.0), (1.0, 1.0, 1.0), (None, 3.0, 2.0)], "a double, b double, c double")
    assert one(P.order_check(df, ["a", "b", "c"])) == {"checked": 3, "failed": 1}


def test_duplicates_keys_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, 7.0), ("b", 2, 7.0), (None, 2, 7.0), (None, 2, 7.0)], "x string, y int, z double")
    assert one(P.exact_duplicates(df)) == {"distinct_rows": 4, "duplicate_groups": 1, "rows_in_duplicate_groups": 2}
    assert one(P.key_profile(df, ["x", "y"])) == {"unique_keys": 3, "duplicate_groups": 2, "rows_in_duplicate_groups": 4, "max_multiplicity": 2}
    nulls = {r["column"]: (r["null_count"], r["null_rate"]) for r in P.null_profile(df).collect()}
    assert nulls == {"x": (2, 0.4), "y": (0, 0.0), "z": (1, 0.2)}
    assert P.duplicated(df, ["x", "y"]).where("is_duplicated").count() == 4


def test_tristate_flags_and_reasons(spark):
    df = spark.createDataFrame([(True, None), (False, "slow: x"), (False, ""), (None, "slow: y"), (False, "slow: z")], "stable boolean, why string")
    got = one(P.flag_by(df, "stable"))
    assert (got["n_true"], got["n_false"], got["n_unknown"], got["rate_true"]) == (1, 3, 1, 0.2)
    assert {r["category"]: r["n"] for r in P.reason_counts(df, "why", "stable").collect()} == {"slow": 2, "none": 1}


def test_iqr_and_numeric_profile(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0, -50.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    x = np.array([v for v in values if v is not None])
    q1, q3 = np.quantile(x, [0.25, 0.75])
    got = one(P.numeric_profile(df, ["v"]))
    assert got["q1"] == pytest.approx(q1) and got["count"] == 6 and got["non_positive"] == 1
    assert got["outliers"] == ((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).sum()


def test_distribution_of_five_values(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)], "v double")
    got = one(P.distribution(df, ["v"]))
    x = np.arange(1, 6)
    assert got["median"] == 3 and got["cv"] == pytest.approx(x.std() / x.mean()) and got["p95"] == pytest.approx(np.quantile(x, 0.95))
    assert got["log10_range"] == pytest.approx(math.log10(5))


def test_length_stats_scale_only_additive_values(spark):
    df = spark.createDataFrame([(2,), (4,), (8,)], "n long")
    a, b = one(P.length_stats(df, "n")), one(P.length_stats(df, "n", repeats=3))
    for k in ("total_count", "total_length", "total_length_sq"):
        assert b[k] == 3 * a[k]
    for k in ("mean", "p50", "p90", "p95", "min", "max", "std"):
        assert b[k] == a[k]
    assert a["total_length_sq"] == 84 and a["std"] == pytest.approx(np.std([2, 4, 8]))
    with pytest.raises(Exception, match="positive lengths"):
        P.length_stats(df.unionByName(spark.createDataFrame([(0,)], "n long")), "n").collect()


def test_coverage_slices(spark):
    df = spark.createDataFrame([("a", True, True), ("a", False, True), ("b", True, False), (None, None, True)], "d string, f boolean, pop boolean")
    got = {(r["population"], r["dimension"], r["value"]): (r["n"], r["n_f"]) for r in P.coverage(df, ["d"], ["f"], "pop").collect()}
    assert got == {("all", "overall", "all"): (4, 2), ("all", "d", "a"): (2, 1), ("all", "d", "b"): (1, 1), ("all", "d", "null"): (1, 0),
                   ("pop", "overall", "all"): (3, 1), ("pop", "d", "a"): (2, 1), ("pop", "d", "null"): (1, 0)}


def test_greedy_cover_equals_brute_force(spark):
    rows = [(i, f"t{i % 3}", f"g{i % 2}", f"s{(i * 7) % 5}") for i in range(40)]
    df = spark.createDataFrame(rows, "k int, t string, g string, s string")
    facets = {"task": F.col("t"), "gpu": F.col("g"), "task_gpu": F.concat_ws("|", "t", "g"), "scale": F.col("s")}
    got = [r["k"] for r in W.representative_sample(df.repartition(3), facets, ["k"], "task_gpu").orderBy("round").collect()]

    def facet_set(r):
        return {f"task:{r[1]}", f"gpu:{r[2]}", f"task_gpu:{r[1]}|{r[2]}", f"scale:{r[3]}"}
    every, covered, picked, left = set().union(*map(facet_set, rows)), set(), [], list(rows)
    while left and len(picked) < 12:
        def score(r):
            new = facet_set(r) - covered
            return (-(len(new) + 3 * sum(f.startswith("task_gpu:") for f in new)), -len(new), r[0])
        best = min(left, key=score)
        if not facet_set(best) - covered and len(picked) >= 9:
            break
        left.remove(best)
        covered |= facet_set(best)
        picked.append(best[0])
        if covered == every and len(picked) >= 9:
            break
    assert got == picked
    manifest = W.cover_manifest(df, df.where(F.col("k").isin(got)), facets)
    assert manifest.where("not covered").count() == 0


# ---- scalars ---------------------------------------------------------------------------------

def test_run_key_keeps_nulls_and_field_order(spark):
    df = spark.createDataFrame([("a", None, 3)], "x string, y string, z int")
    assert one(K.with_run_key(df, ["z", "y", "x"]))["run_key"] == '{"z":3,"y":null,"x":"a"}'
    assert one(K.with_run_key(df.select("z", "x", "y"), ["z", "y", "x"]))["run_key"] == '{"z":3,"y":null,"x":"a"}'


def test_digest_is_order_free_and_value_sensitive(spark):
    rows = [(i, i / 3, "c") for i in range(50)]
    df = spark.createDataFrame(rows, "k int, v double, c string")
    base = one(K.table_digest(df))
    assert one(K.table_digest(spark.createDataFrame(rows[::-1], "k int, v double, c string").repartition(7))) == base
    assert one(K.table_digest(df.withColumn("v", F.when(F.col("k") == 3, 9.0).otherwise(F.col("v")))))["digest"] != base["digest"]
    assert one(K.table_digest(df.withColumn("k", F.col("k").cast("long"))))["schema"] != base["schema"]


def test_paths(spark):
    col = R.path_allowed(F.col("p"), "llm/", "results.json", deny=["timeline", ".bin"])
    for path, ok in (("llm/a/results.json", True), ("LLM\\a\\results.json", True), ("llm/../results.json", False), ("llm/timeline/results.json", False),
                     ("mllm/a/results.json", False), ("llm/a/results.json.txt", False), (None, False)):
        assert value(spark, col, ("p", path)) is ok


def test_prefix_family_and_bins(spark):
    fam = R.prefix_family(F.col("m"), [("Qwen3-Coder", "coder"), ("Qwen3", "base")])
    assert [value(spark, fam, ("m", m)) for m in ("q/Qwen3-Coder-30B", "q/Qwen3-8B", "a/b/c", "plain")] == ["coder", "base", "b/c", "plain"]
    scale = R.bin_scale(F.col("v"), [20, 100], ["small", "medium", "large"])
    assert [value(spark, scale, ("v", v)) for v in (20, 20.5, 100, 101, None)] == ["small", "medium", "medium", "large", None]
    inf = float("inf")
    cut = R.cut(F.col("v"), [-inf, 0.95, 0.99, inf], ["low", "mid", "high"])
    assert [value(spark, cut, ("v", v)) for v in (0.94, 0.95, 0.99)] == ["low", "mid", "high"]


def test_reasons_keep_order_without_repeats(spark):
    col = R.reasons([("b", F.col("x") > 0), ("a", F.col("x") > 1), ("b", F.col("x") > 2)])
    assert [value(spark, col, ("x", x)) for x in (0, 1, 3)] == [None, "b", "b;a"]


def test_flags(spark):
    df = spark.createDataFrame([(1.0, "3"), (None, "4"), (float("inf"), "5"), (-1.0, "x"), (2.0, "x")], "a double, b string")
    assert [r[0] for r in df.select(R.finite_nonneg(["a"])).collect()] == [True, False, False, False, True]
    assert [r[0] for r in df.select(R.finite_nonneg(["a", "b"])).collect()] == [True, False, False, False, False]
    z = R.structural_zero(df.select("a"), "a", F.col("a").isNull() | (F.col("a") > 1)).collect()
    assert [tuple(r) for r in z][1] == (None, True, True) and tuple(z[0]) == (0.0, False, False)
    flags = R.eligibility(df, {"base": F.col("a").isNotNull(), "full": F.col("b") != "x", "top": F.col("a") > 0}).collect()
    assert [(r["base"], r["full"], r["top"]) for r in flags] == [(True, True, True), (False, False, False), (True, True, True), (True, False, False), (True, False, False)]


def test_map_values_required(spark):
    df = spark.createDataFrame([("a",), ("z",)], "k string")
    assert [r[0] for r in df.select(R.map_values(F.col("k"), {"a": 1})).collect()] == [1, None]
    with pytest.raises(Exception, match="unmapped value: z"):
        df.select(R.map_values(F.col("k"), {"a": 1}, required=True)).collect()


def test_secrets_and_identity(spark):
    docs = spark.createDataFrame([(1, "x " * 50000 + "AKIA" + "A" * 16), (2, "hf_" + "a" * 24 + " and sk-" + "b" * 30), (3, "hf_short")], "id int, t string")
    assert sorted((r["id"], r["category"]) for r in T.secret_scan(docs, "t", ["id"]).collect()) == [(1, "cloud_access_key"), (2, "api_key"), (2, "model_hub_token")]
    hits = spark.createDataFrame([(0, "Package "), (0, "package"), (1, "dram"), (1, "core"), (2, " ")], "zone int, name string")
    got = {r["zone"]: (r["status"], r["resolved_name"]) for r in T.resolve_identity(hits, "zone", "name").collect()}
    assert got == {0: ("resolved", "package"), 1: ("conflict", None), 2: ("unresolved", None)}


def test_messages_and_prompts(spark):
    df = spark.createDataFrame([(["hi", "yo", "bye"], "sys"), (["q"], None)], "turns array<string>, s string")
    got = [[(m["role"], m["content"]) for m in r[0]] for r in df.select(T.to_messages("turns", F.col("s"))).collect()]
    assert got == [[("system", "sys"), ("user", "hi"), ("assistant", "yo"), ("user", "bye")], [("user", "q")]]
    prompt, answer = T.choice_prompt(F.col("q"), [F.lit("w1"), F.lit("w2"), F.lit(" w3 ")], F.lit("right"), 1, F.col("q"))
    row = spark.createDataFrame([("why",)], "q string").select(prompt.alias("p"), answer.alias("a")).first()
    letter = row["a"][1]
    assert row["a"].endswith(") right") and f"\n({letter}) right" in row["p"] and "(A)" in row["p"] and "(D)" in row["p"]


def test_flatten_json(spark):
    text = '{"a": {"b": 1, "c": [1, 2, 3], "g": {"0": 2.5}}, "d": "x", "e": null, "f": true}'
    df = spark.createDataFrame([(1, text)], "id int, j string")
    got = {r["path"]: (r["kind"], r["value"], r["length"]) for r in D.flatten_json(df, "j", ["id"]).collect()}
    assert set(got) == {"a.b", "a.c", "a.g.0", "d", "e", "f"}
    assert got["a.c"][0] == "list" and got["a.c"][2] == 3 and got["a.b"][1] == "1" and got["d"] == ("string", "x", None)
    with pytest.raises(Exception, match="nested too deep"):
        D.flatten_json(df, "j", ["id"], depth=1).collect()
    deep = spark.createDataFrame([(1, '{"a":' * 12 + '"{{\\"{"' + "}" * 12), (2, "{}"), (3, None)], "id int, j string")
    assert [(r["path"], r["value"]) for r in D.flatten_json(deep, "j", ["id"]).collect()] == [(".".join("a" * 12), '{{"{')]
    assert df.select(D.has_key(F.col("j"), "g")).first()[0] and not df.select(D.has_key(F.col("j"), "x")).first()[0]


def test_canonical_fields(spark):
    df = spark.createDataFrame([(1, '{"n_local": 8, "w": {"v": 3}}'), (2, '{"n": 4}')], "id int, j string")
    rules = {"experts": ["$.n", "$.n_local"], "width": ["$.w.v"]}
    assert {r["id"]: (r["experts"], r["width"]) for r in D.canonicalise(df, "j", "id", rules).collect()} == {1: ("8", "3"), 2: ("4", None)}
    lines = {(r["id"], r["field"]): (r["source_field"], r["status"]) for r in D.canonical_lineage(df, "j", "id", rules).collect()}
    assert lines[(1, "experts")] == ("$.n_local", "available") and lines[(2, "width")] == (None, "missing")


# ---- proxies ---------------------------------------------------------------------------------

def test_model_shapes(spark):
    l = F.lit
    ev = lambda c: spark.range(1).select(c).first()[0]
    assert ev(X.projection_work(l(10.0), l(8), l(4), l(2), l(2))) == 3840
    assert ev(X.attention_work(l(100.0), l(4), l(2))) == 3200
    assert ev(X.mlp_work(l(10.0), l(8), l(16), l(True))) == 7680 and ev(X.mlp_work(l(10.0), l(8), l(16), l(False))) == 5120
    assert ev(X.mlp_work(l(10.0), l(8), l(4), l(True), l(3))) == 5760
    assert ev(X.cache_bytes(l(10.0), l(3), l(2), l(4), l(2.0))) == 960
    assert ev(X.weight_bytes(l(1000.0), l(8))) == 1000
    assert ev(X.per_unit(l(1000.0), l(4))) == 250 and ev(X.per_unit(l(1000.0), l(4), l(2))) == 500
    assert ev(X.per_unit(l(1000.0), l(4), l(3))) is None


def test_physics_equals_per_request_sums(spark):
    lengths = [3, 10, 25]
    p = dict(layers=4, hidden=8, heads=4, kv_heads=2, head_dim=2, dense_width=16, dense_layers=1, moe_layers=3, moe_width=4, active_experts=2,
             shared_experts=1, shared_width=5, params=1000.0, precision_bits=8, element_bits=16, gated=True, attention_variant="gqa")
    runs = X.length_moments(spark.createDataFrame([(n,) for n in lengths], "n int").withColumn("g", F.lit("g")), ["g"], "n")
    runs = runs.select("*", *[F.lit(v).alias(k) for k, v in {**p, "repeats": 3, "output_cap": 7, "units": 4, "data_parallel": 2}.items()])
    got = one(X.physics_features(runs))
    proj = lambda n: 2 * n * 8 * 8 + 4 * n * 8 * 4 + 2 * n * 8 * 8
    mlp = lambda n: 1 * 6 * n * 8 * 16 + 3 * (6 * n * 8 * 4 * 2 + 6 * n * 8 * 5)
    att = lambda n: 4 * 4 * 2 * n * n
    assert got["prefill_projection"] == 3 * sum(4 * proj(n) for n in lengths)
    assert got["prefill_attention"] == 3 * sum(4 * att(n) for n in lengths)
    assert got["prefill_mlp"] == 3 * sum(mlp(n) for n in lengths)
    step = lambda n, t: 4 * proj(1) + mlp(1) + 4 * 4 * 4 * 2 * (n + t)
    assert got["decode_upper_bound"] == 3 * sum(step(n, t) for n in lengths for t in range(1, 8))
    assert got["kv_cap_sum_bytes"] == 3 * sum(2 * 4 * 2 * 2 * (n + 7) * 2 for n in lengths)
    assert got["kv_prefill_max_bytes"] == 2 * 4 * 2 * 2 * 25 * 2 and got["weight_bytes_per_unit"] == 500 and got["shared_term_included"]
    bad = one(X.physics_features(runs.withColumn("moe_width", F.lit(None).cast("int"))))
    assert bad["physics_status"] == "missing" and bad["physics_missing_reason"] == "missing canonical fields: moe_width" and bad["prefill_total"] is None
    assert one(X.physics_features(runs.withColumn("attention_variant", F.lit("mla"))))["physics_status"] == "unsupported"
    bad = one(X.physics_features(runs.withColumns({"hidden": F.lit(-8), "params": F.lit(float("nan"))})))
    assert (bad["physics_status"], bad["physics_missing_reason"], bad["weight_bytes_total"]) == ("missing", "must be finite and nonnegative: hidden, params", None)


def test_no_letters_beyond_four_choices():
    from plumbline.functions import text
    with pytest.raises(ValueError, match="four|4"):
        text.choice_prompt(F.lit("q"), [F.lit(x) for x in "abcd"], F.lit("e"), 1, F.lit("k"))


def test_coverage_tells_null_from_its_name(spark):
    df = spark.createDataFrame([(None, True), ("null", False), ("null", True)], "d string, f boolean")
    got = {r["value"]: (r["n"], r["n_f"]) for r in P.coverage(df, ["d"], ["f"]).where("dimension = 'd'").collect()}
    assert got == {"null": (1, 1), '"null"': (2, 1)}


def test_hardware_row(spark):
    row = dict(precision="bfloat16", units=2, parallel_units=2, tensor_parallel=2, work=1.979e15, weight_bytes_per_unit=40e9, kv_mean_bytes=16e9, kv_max_bytes=32e9,
               observed_power=700.0, peak16=989.5, bandwidth_gb=3350.0, capacity_gb=80.0, rated_power=700.0)
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()])
    got = one(X.hardware_proxies(df, {"bfloat16": "peak16"}))
    assert got["compute_time"] == pytest.approx(1.0) and got["memory_time"] == pytest.approx(48e9 / 3.35e12)
    assert (got["weight_capacity_ratio"], got["kv_capacity_ratio_mean"], got["kv_capacity_ratio_max"]) == pytest.approx((0.5, 0.1, 0.2))
    assert got["aggregate_rated_power"] == 1400 and got["power_fraction"] == pytest.approx(0.5)
    assert one(X.hardware_proxies(df.withColumn("capacity_gb", F.lit(0.0)), {"bfloat16": "peak16"}))["weight_capacity_ratio"] is None
    assert one(X.hardware_proxies(df, {"fp8": "peak16"}))["compute_time"] is None


# ---- metrics ---------------------------------------------------------------------------------

def test_per_unit_metrics(spark):
    df = spark.createDataFrame([(100.0, 110.0, 1), (800.0, 880.0, 8)], "y double, p double, n int")
    got = one(E.metrics_per_unit(df, "y", "p", "n"))
    assert (got["per_unit_mae"], got["per_unit_rmse"], got["per_unit_signed_bias"]) == (10, 10, 10)
    total = one(E.regression_metrics(df, "y", "p"))
    assert total["mae"] == 45 and total["signed_bias"] == 45


def test_metrics_of_constant_target(spark):
    df = spark.createDataFrame([("a", 5.0, 4.0), ("a", 5.0, 7.0), ("b", 1.0, 1.0)], "g string, y double, p double")
    got = {r["g"]: r for r in E.regression_metrics(df, "y", "p", ["g"]).collect()}
    assert got["a"]["r2"] is None and got["a"]["mdape"] == pytest.approx(30.0) and got["b"]["mae"] == 0
    cal = {r["g"]: r for r in E.calibration(df, "y", "p", ["g"]).collect()}
    assert cal["a"]["calibration_slope"] is None and cal["b"]["calibration_slope"] is None


def test_paired_effect(spark):
    df = spark.createDataFrame([("a", "m1", 100.0, 120.0, 110.0), ("b", "m1", 100.0, 120.0, 110.0), ("c", "m2", 100.0, 120.0, 140.0)], "k string, m string, y double, b double, a double")
    got = one(E.paired_effect(df, "y", "b", "a", "m"))
    assert got["row_weighted_delta_mae"] == pytest.approx(0.0) and got["equal_cluster_delta_mae"] == pytest.approx(5.0)
    df = df.withColumn("a", F.when(F.col("k") == "c", 130.0).otherwise(F.col("a")))
    got = one(E.paired_effect(df, "y", "b", "a", "m"))
    assert got["row_weighted_delta_mae"] == pytest.approx(-10 / 3) and got["equal_cluster_delta_mae"] == pytest.approx(0.0)


def test_weights(spark):
    df = spark.createDataFrame([(25.0,), (100.0,), (400.0,), (10000.0,)], "y double")
    got = [r["weight"] for r in N.high_value_weights(df, "y").orderBy("y").collect()]
    assert got == pytest.approx([0.5, math.sqrt(100 / 250), math.sqrt(400 / 250), 2.0])


def test_targets_round_trip(spark):
    df = spark.createDataFrame([(0.0, 2.0), (10.0, 4.0)], "y double, n double")
    back = df.select(N.restore_target(N.transform_target(F.col("y"), "log1p", F.col("n")), "log1p", F.col("n")).alias("r")).collect()
    assert [r["r"] for r in back] == pytest.approx([0.0, 10.0])
    with pytest.raises(Exception, match="negative target under log1p"):
        spark.createDataFrame([(-1.0,)], "y double").select(N.transform_target(F.col("y"), "log1p")).collect()


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([(g, float(v)) for g in ("a", None) for v in range(8)], "g string, v double")
    bins = W.qcut(df, "v", 4, ["g"])
    assert bins.where("g is null").select("bin").distinct().count() == 4
    assert W.avg_rank(df, "v", ["g"]).where("g is null and avg_rank is null").count() == 0
    tails = E.error_slices(df.withColumns({"p": F.col("v") + 1, "c": F.lit("x")}), "v", "p", "v", "c", {}, {"top": 0.5}, by=["g"])
    assert tails.where("slice_type = 'top'").count() == 2
    long = spark.createDataFrame([(None, "x"), (None, "x"), ("p", "y")], "path string, value string")
    assert {r["path"]: r["present"] for r in P.summarise_values(long).collect()} == {None: 2, "p": 1}
    named = spark.createDataFrame([("g", None), ("g", "null"), (None, "a"), ("g", "null")], "g string, v string")
    assert {r["g"]: (r["composition"], r["missing"]) for r in P.composition_json(named, "g", "v").collect()} == {"g": ('{"null":2}', 1), None: ('{"a":1}', 0)}


def test_nan_is_missing(spark, tmp_path):
    from plumbline.sources import readers as R
    spark.createDataFrame([(float("nan"), 1), (2.0, 2), (None, 3)], "v double, k int").write.parquet(str(tmp_path / "t"))
    assert {r["column"]: r["null_count"] for r in P.null_profile(spark.read.parquet(str(tmp_path / "t"))).collect()} == {"v": 2, "k": 0}
    assert R.read_runs(spark, str(tmp_path / "t")).where("v is null").count() == 2


def test_digest_sees_small_and_large_doubles(spark):
    digests = {one(K.table_digest(spark.createDataFrame([(v,)], "v double")))["digest"] for v in (1e-9, 4e-7, 1e40, 1e41, 0.0, float("nan"))}
    assert len(digests) == 6
    assert one(K.table_digest(spark.createDataFrame([(-0.0,)], "v double"))) == one(K.table_digest(spark.createDataFrame([(0.0,)], "v double")))


def brute_picks(n, leaf, draws, seed):
    """Per draw the places in hash order that it takes: the tree in plain Python, binomials from exact sums."""
    import hashlib
    import math
    import zlib
    from fractions import Fraction
    blocks = 1
    while blocks * leaf < n:
        blocks *= 2
    start = [-(-b * n // blocks) for b in range(blocks + 1)]

    def mix(x):
        for _ in range(2):
            x = ((x ^ (x >> 16)) * 0x45D9F3B) & 0xFFFFFFFF
        return x ^ (x >> 16)

    def walk(d, node, low, high, taken):
        if high - low == 1:
            base = mix((mix((zlib.crc32(str(seed).encode()) + d) & 0xFFFFFFFF) + low) & 0xFFFFFFFF)
            other = mix(base ^ 0x5BD1E995)
            for j in range(taken):
                first = mix((base + j) & 0xFFFFFFFF)
                yield start[low] + (mix(first ^ other) * (1 << 20) + (mix((first + other) & 0xFFFFFFFF) >> 12)) % (start[low + 1] - start[low])
            return
        mid = (low + high) // 2
        p = Fraction(start[mid] - start[low], start[high] - start[low])
        u, reached, k = Fraction(int(hashlib.md5(f"{seed}|{d}|{node}".encode()).hexdigest()[:13], 16), 1 << 52), 0, -1
        while reached < u or k < 0:
            k += 1
            reached += math.comb(taken, k) * p ** k * (1 - p) ** (taken - k)
        yield from walk(d, 2 * node, low, mid, k)
        yield from walk(d, 2 * node + 1, mid, high, taken - k)
    return [list(walk(d, 1, 0, blocks, n)) for d in range(draws)]


@pytest.mark.parametrize("leaf", [1024, 3])
def test_bootstrap_equals_brute_force(spark, leaf):
    import hashlib
    rng = np.random.default_rng(4)
    rows = [(f"m{i % 23}" if i % 3 else "hot", float(rng.normal()), float(rng.normal())) for i in range(400)] + [("nothing", None, None)]
    df = spark.createDataFrame(rows, "m string, y double, p double")
    clusters = E.cluster_sums(E.error_delta(df.withColumn("z", F.lit(0.0)), "y", "z", "p", "e"), "m", "e")
    groups = {m: [(y, p) for g, y, p in rows if g == m and y is not None] for m in {r[0] for r in rows}}
    order = sorted(groups, key=lambda m: (hashlib.md5(f"3|{m}".encode()).hexdigest(), m))
    picks = brute_picks(len(order), leaf, 30, 3)
    assert all(len(p) == len(order) for p in picks)
    delta = {m: [abs(p - y) - abs(y) for y, p in g] for m, g in groups.items()}
    got = {r["draw"]: r for r in E.bootstrap_draws(clusters, "m", 30, 3, leaf).collect()}
    again = {r["draw"]: r for r in E.bootstrap_metrics(df.repartition(3), "y", "p", "m", 30, 3, leaf=leaf).collect()}
    assert set(got) == set(again) == set(range(30))
    for d, own in enumerate(picks):
        taken = [delta[order[i]] for i in own]
        assert got[d]["row_weighted_delta"] == pytest.approx(sum(map(sum, taken)) / sum(map(len, taken)))
        assert got[d]["equal_cluster_delta"] == pytest.approx(np.mean([np.mean(x) for x in taken if x]))
        y, p = np.array([x for i in own for x in groups[order[i]]]).T
        r, total = p - y, ((y - y.mean()) ** 2).sum()
        want = [np.abs(r).mean(), np.sqrt((r * r).mean()), 1 - (r * r).sum() / total, np.median(np.abs(r) / np.abs(y) * 100), (200 * np.abs(r) / (np.abs(y) + np.abs(p))).mean(), r.mean()]
        assert [again[d][k] for k in ("mae", "rmse", "r2", "mdape", "smape", "signed_bias")] == pytest.approx(want)


def test_draws_take_clusters_as_often_as_they_should():
    from plumbline.operators import resample
    n, blocks, draws = 3000, resample.block_count(3000, 500), 400
    parts = [np.concatenate([m for _, m in resample.multiplicities(b, n, blocks, draws, 9)]) for b in range(blocks)]
    counts = np.concatenate(parts, axis=1)
    assert counts.shape == (draws, n) and (counts.sum(axis=1) == n).all()
    assert abs(counts.var() - 1) < 0.02 and np.abs(counts.mean(axis=0) - 1).max() < 0.3
    assert abs(np.corrcoef(counts[:, 0], counts[:, 1])[0, 1]) < 0.2 and abs(np.corrcoef(counts[0], counts[1])[0, 1]) < 0.1


def test_a_group_of_blocks_divides_every_node_once(monkeypatch):
    from plumbline.operators import resample
    n, blocks, draws, calls = 40_000, 256, np.arange(50), []
    real = resample.binomial
    monkeypatch.setattr(resample, "binomial", lambda u, k, p: calls.append(p) or real(u, k, p))
    leaves = dict(resample.taken_by_blocks(range(128, 192), n, blocks, draws, 5))
    assert sorted(leaves) == list(range(128, 192)) and len(calls) == 2 + 63  # the way down to the subtree, and each of its nodes
    assert all((leaves[b] == next(resample.taken_by_blocks([b], n, blocks, draws, 5))[1]).all() for b in (128, 150, 191))
    assert (sum(t for _, t in resample.taken_by_blocks(range(blocks), n, blocks, draws, 5)) == n).all()
    assert resample.group_count(n, blocks) == 64 and resample.group_count(10, 8) == 8 and resample.group_count(1 << 24, 4096) == 128


def test_binomials_reach_their_distribution():
    import math
    from plumbline.operators import resample
    u, exact = np.linspace(0, 1, 401)[:-1] + 1e-9, []
    for x in u:
        reached, k = 0.0, -1
        while reached < x:
            k += 1
            reached += math.comb(60, k) * 0.3 ** k * 0.7 ** (60 - k)
        exact.append(k)
    assert resample.binomial(u, np.full(400, 60), 0.3).tolist() == exact
    big = resample.binomial(u, np.full(400, 10**8), 0.5)
    assert abs(big.mean() - 5e7) < 500 and abs(big.std() / 5000 - 1) < 0.05
    assert resample.binomial(u[:3], np.array([0, 5, 7]), 1.0).tolist() == [0, 5, 7] and resample.binomial(u[:1], np.array([0]), 0.5).tolist() == [0]


def test_candidate_choices(spark):
    errors = spark.createDataFrame([(0, 10.0, 5, False), (0, 10.0, 5, False), (1, 30.0, 10, False), (1, 0.0, 5, False), (2, 0.0, 10, True)],
                                   "candidate int, abs_error_sum double, n_rows long, failed boolean")
    best = E.select_candidate(errors, [], failed="failed").first()
    assert best["candidate"] == 0 and best["score"] == 2.0
    cells = spark.createDataFrame([("best", 10.0, 1.0, 100.0, 50.0), ("tail", 10.4, 1.0, 94.0, -30.0), ("far", 11.0, 1.0, 10.0, 1.0)],
                                  "id string, mae double, rmse double, upper_mae double, upper_signed_bias double")
    assert E.choose_final(cells, ["id"]).first()["id"] == "tail"
    assert E.choose_final(cells.where("id <> 'tail'"), ["id"]).first()["id"] == "best"
    matrix = spark.createDataFrame([("L1", "main", "Ridge", "T", 5.0, 6.0), ("L1", "post_hoc", "X", "T", 1.0, 1.0), ("L1", "main", "Ridge", "G", 5.0, 7.0)],
                                   "level string, role string, algorithm string, strategy string, mae double, rmse double")
    won = E.choose_level(matrix, "level", ["mae", "rmse", "algorithm", "strategy"], "role").first()
    assert (won["algorithm"], won["strategy"]) == ("Ridge", "T")


# ---- plans and gates -------------------------------------------------------------------------

def test_bundles():
    got = resolve_bundles({"B": {"base": "A", "numeric_add": ["n2", "n1"], "drop": ["c1"]}, "A": {"numeric": ["n1"], "categorical": ["c1", "c2"]}})
    assert got["B"] == {"numeric": ["n1", "n2"], "categorical": ["c2"], "columns": ["c2", "n1", "n2"]}
    with pytest.raises(ValueError, match="unresolved"):
        resolve_bundles({"A": {"base": "B"}, "B": {"base": "A"}})


def test_boundary():
    with pytest.raises(ValueError, match="y_power"):
        G.assert_boundary(["x_a", "y_power"])
    with pytest.raises(ValueError, match="x_latency"):
        G.assert_boundary(["x_a", "x_latency"], forbid=["latency"])
    G.assert_boundary(["x_a"])


def test_role_manifest_rejects_unknown_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x_a double, x_b double")
    with pytest.raises(ValueError, match="x_b"):
        P.role_manifest(df, {"x_a": "X_model"})


def test_mutations_fail_the_gates(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("b", 2.0, True)], "k string, y double, ok boolean")
    good = [G.check_unique(df, ["k"], 2), G.check_ranges(df, ["y"]), G.check_flags(df, {"ok": F.col("y") > 0}, counts={"ok": 2}), G.check_population(df, 2)]
    assert G.run_checks(good).where("status <> 'pass'").count() == 0
    for bad in (G.check_unique(df.unionByName(df.limit(1)), ["k"]), G.check_ranges(df.withColumn("y", F.lit(float("nan"))), ["y"]),
                G.check_flags(df.withColumn("ok", F.lit(False)), {"ok": F.col("y") > 0}), G.check_population(df, 3),
                G.check_formula(df, {"y": F.col("y") * 2})):
        with pytest.raises(ValueError, match="checks failed"):
            G.run_checks([bad])


def test_frozen_digest_and_revisions(spark):
    df = spark.createDataFrame([("m", "a" * 40, "public", True), ("n", "b" * 39, "secret", None)], "model string, rev string, acc string, sta boolean")
    frozen = one(K.table_digest(df))
    assert G.check_digest(df, frozen).where("status = 'fail'").count() == 0
    assert G.check_digest(df.withColumn("acc", F.lit("x")), frozen).where("status = 'fail'").count() == 1
    got = {r["name"]: r["status"] for r in G.check_revisions(df, "model", "rev", "acc", ["public", "restricted"], "sta", 2).collect()}
    assert got == {"revisions:count": "pass", "revisions:hex40": "fail", "revisions:access": "fail", "revisions:static_only": "fail"}


def test_stale_fingerprints_are_missing(spark):
    plan = M.with_fingerprint(spark.createDataFrame([("e1",), ("e2",), ("e3",)], "experiment_id string"), {"data": "d1"})
    old = M.with_fingerprint(spark.createDataFrame([("e2",)], "experiment_id string"), {"data": "d0"})
    stored = plan.where("experiment_id = 'e1'").unionByName(old).withColumn("run_key", F.lit(1))
    got = {r["experiment_id"]: r["status"] for r in M.matrix_progress(plan, stored, expected_rows=1).collect()}
    assert got == {"e1": "complete", "e2": "stale", "e3": "missing"}
    assert M.matrix_progress(plan, stored, expected_rows=2).where("status = 'partial'").count() == 1
    assert sorted(r[0] for r in M.pending(stored, plan).select("experiment_id").collect()) == ["e2", "e3"]
    with pytest.raises(ValueError, match="incomplete"):
        M.require_complete(M.matrix_progress(plan, stored))


def test_slices_store_each_row_once(spark, monkeypatch):
    from plumbline.session import cut_lineage
    df = spark.createDataFrame([("s", f"c{i % 3}", "ab"[i % 2] if i % 5 else None, float(i + 1), float(i * i % 7), 1 + i % 2) for i in range(20)], "g string, c string, d string, y double, p double, u int")
    stored = []
    def spied(rows):
        stored.append(rows.count())
        return cut_lineage(rows)
    monkeypatch.setattr(E, "cut_lineage", spied)
    got = {(r["slice_type"], r["slice_value"]): r for r in E.error_slices(df, "y", "p", "u", "c", {"d": "d"}, {"top": 0.5}, 2, ["g"]).collect()}
    assert stored == [20]
    pdf = df.toPandas()
    for key, mine in ((("overall", "all"), pdf), (("d", "a"), pdf[pdf.d == "a"]), (("top", "tail"), pdf[pdf.y >= 10.5]), (("target_quartile", "Q1"), pdf[pdf.y <= 10.5])):
        assert got[key]["n_rows"] == len(mine) and got[key]["n_clusters"] == mine.c.nunique()
        assert got[key]["residual_median"] == (mine.p - mine.y).median()
    assert ("d", None) not in got and len(got) == 6


def test_slices_of_few_cells_equal_those_dealt_to_slices(spark, monkeypatch):
    """Null groups, clusters and dimensions; medians come from counts, without rows dealt to slices."""
    rows = [(None if i % 4 == 3 else "s", None if i % 11 == 0 else i % 6, "ab"[i % 2] if i % 5 else None, float(i * 37 % 101), float(i * i % 17), 1 + i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "g string, c long, d string, y double, p double, u int")
    def found():
        out = E.error_slices(df, "y", "p", "u", "c", {"d": "d", "u": "u"}, {"top": 0.9}, 3, ["g"]).collect()
        return sorted(str([round(x, 8) if isinstance(x, float) else x for x in r]) for r in out)
    monkeypatch.setattr(E, "BITS", 5)  # several numbers
    calls, dealt = [], E.quantile_table
    monkeypatch.setattr(E, "quantile_table", lambda *a, **k: calls.append(k.get("sets")) or dealt(*a, **k))
    quick = found()
    assert calls == [None]
    monkeypatch.setattr(E, "MOST_SLICES", 3)
    assert found() == quick and len(calls) == 3 and calls[2] and len(quick) > 16
