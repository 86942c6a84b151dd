"""Cardinality contracts, hot keys, upserts, reconciliation and set comparisons on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import joins as J
from plumbline.operators import sets as S


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("limit", [-1, 1 << 30])
def test_many_to_one_with_hot_and_null_keys(spark, how, limit):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    left = spark.createDataFrame([(1 if i % 3 else (None if i % 2 else i), i) for i in range(900)], "k int, v int")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(0, 500)], "k int, name string")
    right = right.unionByName(spark.createDataFrame([(None, "none")], "k int, name string"))
    got = J.join_many_to_one(left, right, "k", how)
    want = left.join(right, "k", how)
    assert rows(got, "k", "v", "name") == rows(want, "k", "v", "name")
    safe = J.join_many_to_one(left, right, "k", how, null_safe=True)
    assert safe.where("k is null and name = 'none'").count() == left.where("k is null").count()
    assert rows(safe.where("k is not null"), "k", "v", "name") == rows(want.where("k is not null"), "k", "v", "name")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_repeated_pair_fails(spark):
    runs = spark.createDataFrame([("a", 1, 3)], "k string, p int, n int")
    stats = spark.createDataFrame([("a", 1, 5.0)], "k string, p int, x double")
    assert rows(J.expand_pairs(runs, stats, ["k", "p"], "n", ["x"]), "k", "x") == [("a", 15.0)]
    with pytest.raises(Exception, match="duplicate key in pair statistics"):
        J.expand_pairs(runs, stats.union(stats), ["k", "p"], "n", ["x"]).collect()


def test_an_aggregate_is_broadcast(spark):
    left = spark.range(100_000).select((F.col("id") % 3).alias("k"), "id").repartition(4)
    joined = J.join_many_to_one(left, left.groupBy("k").agg(F.count("*").alias("n")), "k", null_safe=True)
    joined.write.format("noop").mode("overwrite").save()
    joined.collect()
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_validated_join_raises_on_repeated_key(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b")], "k int, x string")
    right = spark.createDataFrame([(1, "r"), (1, "s")], "k int, y string")
    with pytest.raises(Exception, match="duplicate key in right side"):
        J.join_validated(left, right, "k").collect()
    one = right.limit(1)
    assert J.join_validated(left, one, "k").count() == 2
    with pytest.raises(Exception, match="duplicate key in left side"):
        J.join_validated(left, one, "k", cardinality="one_to_one").collect()


def test_enrich_raises_on_unmapped_key(spark):
    dim = spark.createDataFrame([("a", 1)], "k string, v int")
    assert J.enrich(spark.createDataFrame([("a",)], "k string"), dim, "k").first()["v"] == 1
    for bad in ("b", None):
        with pytest.raises(Exception, match="unmapped k"):
            J.enrich(spark.createDataFrame([("a",), (bad,)], "k string"), dim, "k").collect()


def test_merge_prior_fills_only_missing(spark):
    prior = spark.createDataFrame([("keep", "available", 10), ("fill", "missing", None), ("none", "missing", None)], "run_key string, status string, total long")
    updates = spark.createDataFrame([("keep", "available", 999, "x"), ("fill", "available", 20, "y")], "run_key string, status string, total long, note string")
    got = {r["run_key"]: (r["status"], r["total"], r["note"]) for r in J.merge_prior(prior, updates, "run_key", "status").collect()}
    assert got == {"keep": ("available", 10, None), "fill": ("available", 20, "y"), "none": ("missing", None, None)}


def test_reconcile_rows(spark):
    df = spark.createDataFrame([(1, 100, 100, 10, 10), (2, 100, 80, 8, 10), (3, 100, 90, 10, 10), (4, None, 90, 10, 10), (5, 0, 1, 1, 1)],
                               "k int, p long, a long, c long, n long")
    got = {r["k"]: r for r in J.reconcile(df, "p", "a", "c", "n").collect()}
    assert got[1]["exact_match"] is True and got[1]["reconciliation_status"] == "exact" and got[1]["reconciliation_reason"] is None
    assert got[2]["comparison_scope"] == "incomplete_run_diagnostic" and got[2]["exact_match"] is None
    assert got[3]["exact_match"] is False and got[3]["relative_error"] == pytest.approx(-0.1)
    assert got[4]["comparison_scope"] == "missing_value" and got[4]["absolute_error"] is None
    assert got[5]["relative_error"] is None


def test_pairing_needs_identical_support(spark):
    a = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, p double")
    b = spark.createDataFrame([("a", 3.0), ("b", 4.0)], "k string, p double")
    assert rows(J.pair_predictions(a, b, "k", "p"), "k", "p_before", "p_after") == [("a", 1.0, 3.0), ("b", 2.0, 4.0)]
    for wrong in (b.limit(1), b.unionByName(b.limit(1))):
        with pytest.raises(Exception, match="identical unique support"):
            J.pair_predictions(a, wrong, "k", "p").collect()


def test_attach_folds_raises_without_fold(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "g string, v int")
    folds = spark.createDataFrame([("a", 0)], "g string, fold int")
    with pytest.raises(Exception, match="no fold for"):
        J.attach_folds(df, folds, "g").collect()


def test_paired_keys(spark):
    df = spark.createDataFrame([("k", "H"), ("k", "H"), ("k", "B"), ("m", None), ("m", "H")], "key string, hw string")
    assert J.paired_key_counts(df, ["key"], "hw", "H", "B").first().asDict() == {"paired_keys": 1, "all_keys": 2}


def test_multiset_difference_counts_nulls_and_copies(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    b = spark.createDataFrame([(1, None), (3, "y")], "a int, b string")
    assert S.multiset_diff(a, b, ["a", "b"]).first().asDict() == {"only_in_a": 2, "only_in_b": 1, "total_difference": 3}
    assert S.multiset_diff(a, a, ["a", "b"]).first()["total_difference"] == 0
    with pytest.raises(ValueError):
        S.assert_disjoint(a, b, "a")
    with pytest.raises(ValueError):
        S.assert_same_support(a, a, ["a"])


def test_frames_differ_names_the_column(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", None)], "k int, s string, v double")
    b = a.withColumn("v", F.when(F.col("k") == 2, 5.0).otherwise(F.col("v")))
    assert {r["what"]: r["n"] for r in J.frames_differ(a, b, "k", ["s", "v"]).collect()} == {"rows only in first": 0, "rows only in second": 0, "s": 0, "v": 1}


def test_cross_plans(spark):
    plan = J.cross_plan(spark, algorithm=["a", "b"], bundle=["x", "y", "z"])
    assert plan.distinct().count() == 6
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 2), (None, 1)], "p string, q int")
    assert J.data_plan(df, ["p", "q"]).count() == 4


def test_frames_with_null_keys_equal_themselves(spark):
    a = spark.createDataFrame([(None, 1.0, "x"), (1, None, "y"), (2, 3.0, None)], "k int, v double, s string")
    assert all(r["n"] == 0 for r in J.frames_differ(a, a, "k", ["v", "s"]).collect())
    b = spark.createDataFrame([(None, 2.0, "x"), (1, None, "y"), (5, 3.0, None), (5, 3.0, None)], "k int, v double, s string")
    assert {r["what"]: r["n"] for r in J.frames_differ(a, b, "k", ["v", "s"]).collect()} == {"rows only in first": 1, "rows only in second": 2, "v": 1, "s": 0}
