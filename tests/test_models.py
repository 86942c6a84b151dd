"""Fits against closed forms, isolation of held-out rows, and one-shot evaluation."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.splits import group_folds
from plumbline.plans import models as P


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        a, b, c = rng.normal(), rng.uniform(0, 5), ["u", "v", "w"][i % 3]
        rows.append((i, f"g{i % 12}", float(a), None if i % 17 == 0 else float(b), c, int(1 + i % 4), float(20 + 3 * a + 2 * b + (5 if c == "w" else 0) + rng.normal() * 0.1)))
    path = str(tmp_path_factory.mktemp("data") / "t")
    spark.createDataFrame(rows, "run_key int, g string, a double, b double, c string, n int, y double").write.parquet(path)
    df = spark.read.parquet(path)
    return df.join(group_folds(df, "g", 3, 1).select("g", "fold"), "g")


SPEC = P.Spec(["a", "b"], ["c"], "y")


def design(train, test, scale=True):
    """Median impute, missing flag, one-hot, population scaling: the same features in numpy."""
    med = train.b.median()
    def block(x):
        b = x.b.fillna(med)
        return np.column_stack([x.a, b, x.b.isna()])
    num, mean, std = block(train), block(train).mean(0), block(train).std(0)
    cats = sorted(train.c.unique())
    hot = lambda x: np.column_stack([(x.c == k) for k in cats]).astype(float)
    make = lambda x: np.column_stack([(block(x) - mean) / std, hot(x)])
    return make(train), make(test)


def test_ridge_equals_closed_form(data):
    pdf = data.toPandas()
    got = P.oof_linear(data, "fold", SPEC, alpha=2.0).toPandas().set_index("run_key").prediction
    for k in range(3):
        train, test = pdf[pdf.fold != k], pdf[pdf.fold == k]
        x, z = design(train, test)
        mu, ym = x.mean(0), train.y.mean()
        w = np.linalg.solve((x - mu).T @ (x - mu) + 2.0 * np.eye(x.shape[1]), (x - mu).T @ (train.y - ym))
        assert np.allclose(got[test.run_key], (z - mu) @ w + ym, atol=1e-6)


def test_elastic_net_satisfies_its_optimality(data):
    """Coordinate descent on (1/2n)|y-xw|² + alpha*(r*|w|₁ + (1-r)/2*|w|²) gives the same predictions."""
    pdf = data.toPandas()
    got = P.oof_linear(data, "fold", SPEC, alpha=0.3, l1_ratio=0.5).toPandas().set_index("run_key").prediction
    train, test = pdf[pdf.fold != 0], pdf[pdf.fold == 0]
    x, z = design(train, test)
    mu, ym, n = x.mean(0), train.y.mean(), len(train)
    xc, r, w = x - mu, (train.y - ym).to_numpy(), np.zeros(x.shape[1])
    for _ in range(5000):
        for j in range(len(w)):
            r = r + xc[:, j] * w[j]
            rho = xc[:, j] @ r / n
            w[j] = np.sign(rho) * max(abs(rho) - 0.15, 0) / (xc[:, j] @ xc[:, j] / n + 0.15)
            r = r - xc[:, j] * w[j]
    assert np.allclose(got[test.run_key], (z - mu) @ w + ym, atol=1e-3)


def test_unseen_category_and_null_give_a_prediction(spark, data):
    model = P.fit(data, SPEC, {"alpha": 1.0})
    odd = spark.createDataFrame([(1.0, None, "never seen"), (1.0, 2.0, None)], "a double, b double, c string")
    got = [r["prediction"] for r in model.predict(odd).collect()]
    assert all(np.isfinite(got))


@pytest.mark.parametrize("spec, params", [(SPEC, {"alpha": 1.0}), (replace(SPEC, algorithm="forest"), {"numTrees": 3, "maxDepth": 3}),
                                          (replace(SPEC, algorithm="boosted", objective="absolute"), {"maxIter": 2}), (replace(SPEC, algorithm="mean", unit="n"), {})])
def test_held_out_target_is_never_read(data, spec, params):
    changed = data.withColumn("y", F.when(F.col("fold") == 1, F.col("y") * 1000).otherwise(F.col("y")))
    a = P.oof_fixed(data, "fold", spec, params).where("fold = 1").orderBy("run_key").select("prediction").toPandas()
    b = P.oof_fixed(changed, "fold", spec, params).where("fold = 1").orderBy("run_key").select("prediction").toPandas()
    assert np.allclose(a.prediction, b.prediction)


def test_nested_cv_picks_the_better_candidate(data):
    predictions, meta = P.nested_cv(data, "fold", "g", SPEC, [{"alpha": 1e6}, {"alpha": 0.1}])
    assert predictions.count() == 240 and predictions.where("prediction is null").count() == 0
    for row in meta.collect():
        assert row["selected"] == 1 and row["scores"][1] < row["scores"][0]
        assert row["train_rows"] + row["test_rows"] == 240 and row["train_groups"] == 8


def test_failed_candidates_lose(data):
    choice = P.select_by_group_cv(data, "g", replace(SPEC, algorithm="forest"), [{"numTrees": -1}, {"numTrees": 2}])
    assert choice.selected == 1 and choice.scores[0] is None and choice.failures[0]
    with pytest.raises(ValueError, match="all candidates failed"):
        P.select_by_group_cv(data, "g", replace(SPEC, algorithm="forest"), [{"numTrees": -1}, {"numTrees": -2}])


def test_importance_ranks_the_driver_first(data):
    model = P.fit(data, SPEC, {"alpha": 0.1})
    rows = P.permutation_importance(model, data, ["run_key"], repeats=3).collect()
    got = {r["feature"]: r["importance_mean"] for r in rows}
    assert got["a"] > got["c"] and got["b"] > got["c"] and all(r["repeats"] == 3 for r in rows)


def test_partial_dependence_of_a_linear_model_is_a_line(data):
    model = P.fit(data, SPEC, {"alpha": 0.0})
    got = P.partial_dependence(model, data, data, ["a"]).toPandas().sort_values("grid_value")
    slope = np.diff(got["mean"]) / np.diff(got.grid_value)
    assert len(got) == 9 and np.allclose(slope, slope[0], atol=1e-6) and slope[0] == pytest.approx(3, abs=0.1)


def test_pca_variance_sums_to_one(data):
    got = P.pca_variance(data, ["a", "b", "y"]).toPandas()
    assert got.variance_ratio.sum() == pytest.approx(1) and got.cumulative_ratio.iloc[-1] == pytest.approx(1)
    x = np.log1p(data.dropna(subset=["a", "b", "y"]).select("a", "b", "y").toPandas().clip(lower=0).to_numpy())
    x = (x - x.mean(0)) / x.std(0)
    eig = np.sort(np.linalg.eigvalsh(x.T @ x))[::-1]
    assert np.allclose(got.variance_ratio, eig / eig.sum())


def test_one_shot_evaluation(spark, data, tmp_path):
    train, test = data.where("fold <> 0"), data.where("fold = 0")
    path = str(tmp_path / "locked")
    first = P.evaluate_once(train, test, SPEC, {"alpha": 1.0}, path, ["run_key"], "g")
    again = P.evaluate_once(train, test, SPEC, {"alpha": 1.0}, path, ["run_key"], "g")
    assert first.exceptAll(again).count() == 0 and first.count() == test.count()
    with pytest.raises(ValueError, match="does not match its lock"):
        P.evaluate_once(train, test, SPEC, {"alpha": 2.0}, path, ["run_key"], "g")
    with pytest.raises(ValueError, match="both sides"):
        P.evaluate_once(train, data, SPEC, {"alpha": 1.0}, str(tmp_path / "other"), ["run_key"], "g")


@pytest.mark.parametrize("algorithm, params", [("ridge", {"alpha": 1.0}), ("mean", {}), ("forest", {"numTrees": 3})])
def test_saved_model_predicts_the_same(spark, data, tmp_path, algorithm, params):
    model = P.fit(data, replace(SPEC, algorithm=algorithm), params)
    model.save(str(tmp_path / "m"))
    again = P.FittedModel.load(spark, str(tmp_path / "m"))
    assert again.spec == replace(model.spec, numeric=list(SPEC.numeric), categorical=list(SPEC.categorical))
    want = {r["run_key"]: r["prediction"] for r in model.predict(data).collect()}
    assert {r["run_key"]: r["prediction"] for r in again.predict(data).collect()} == want


def test_products_equal_fits_one_by_one(spark, data):
    """Folds, inner folds, candidates and slices from sums of products against MLlib fits of each training part."""
    from plumbline.plans import gram
    odd = data.withColumns({"c": F.when(F.col("run_key") % 23 == 0, None).when((F.col("fold") == 1) & (F.col("run_key") % 5 == 0), "only here").otherwise(F.col("c")),
                            "s": F.col("run_key") % 2, "y": F.col("y") + 1e6})
    for spec, params in ((SPEC, {"alpha": 0.7}), (replace(SPEC, unit="n", transform="log1p"), {"alpha": 3.0}), (replace(SPEC, algorithm="elastic_net"), {"alpha": 0.2, "l1_ratio": 0.6})):
        got = gram.out_of_fold(odd, "fold", spec, params, ["s"]).toPandas().set_index("run_key").prediction
        for s in (0, 1):
            model = P.fit(odd.where((F.col("fold") != 1) & (F.col("s") == s)), spec, params)
            want = model.predict(odd.where((F.col("fold") == 1) & (F.col("s") == s))).toPandas().set_index("run_key").prediction
            assert np.allclose(got[want.index], want, rtol=1e-6 if spec.algorithm == "ridge" else 1e-5)


def test_nested_scores_equal_a_search_by_fits(data, monkeypatch):
    grid = [{"alpha": 50.0}, {"alpha": 0.5}, {"alpha": 5.0}]
    quick, meta = P.nested_cv(data, "fold", "g", SPEC, grid, inner_k=2)
    monkeypatch.setattr(P, "by_products", lambda spec: False)
    slow, want = P.nested_cv(data, "fold", "g", SPEC, grid, inner_k=2)
    for a, b in zip(meta.orderBy("fold").collect(), want.orderBy("fold").collect()):
        assert a["selected"] == b["selected"] and np.allclose(a["scores"], b["scores"]) and a["train_rows"] == b["train_rows"] and a["train_groups"] == b["train_groups"]
    both = quick.select("run_key", "selected_candidate", F.col("prediction").alias("p")).join(slow.select("run_key", "prediction"), "run_key")
    assert both.count() == 240 and both.where(F.abs(F.col("p") - F.col("prediction")) > 1e-6).count() == 0


def test_coordinate_descent_meets_its_conditions():
    from plumbline.plans.gram import descend
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 9)) @ rng.normal(size=(9, 9))
    g, t = x.T @ x / 60, x.T @ rng.normal(size=60) / 60
    for l1, l2 in ((0.05, 0.0), (0.02, 0.3), (0.0, 1.0), (10.0, 0.1)):
        w = descend(g, t, l1, l2)
        slope = g @ w - t + l2 * w
        assert np.abs(np.where(w != 0, slope + l1 * np.sign(w), np.maximum(np.abs(slope) - l1, 0))).max() < 1e-9
    assert not descend(g, t, 1e6, 0.0).any() and descend(np.array([[2.0]]), np.array([3.0]), 1.0, 0.0)[0] == 1.0


def test_too_many_categories_are_fitted_without_products(spark, data, monkeypatch):
    from plumbline.plans import gram
    want = P.oof_linear(data, "fold", SPEC, alpha=2.0).select("run_key", F.col("prediction").alias("p"))
    monkeypatch.setattr(gram, "MOST_COLUMNS", 4)
    assert gram.out_of_fold(data, "fold", SPEC, {"alpha": 2.0}) is None
    both = P.oof_linear(data, "fold", SPEC, alpha=2.0).join(want, "run_key")
    assert both.count() == 240 and both.where(F.abs(F.col("p") - F.col("prediction")) > 1e-5).count() == 0


def test_stored_category_names(spark, monkeypatch, tmp_path):
    """The same features and fits whether names are held or stored; far more names than are held; nulls, unknown names, ties of the mode, a column without a name."""
    from functools import partial

    from plumbline.plans import models as P
    rows = spark.createDataFrame([(float(i % 7), None if i % 9 == 4 else f"c{i % 5}", "xyz"[i % 3], None, float(i % 5 * 3 + i % 7)) for i in range(90)], "a double, b string, c string, d string, y double")
    odd = spark.createDataFrame([(1.0, "new", "x", "d", 0.0), (None, None, None, None, 0.0), (2.0, "", "z", None, 0.0)], rows.schema)
    both = rows.unionByName(odd)
    held = P.Preprocessor(["a"], ["b", "c", "d"], scale=True).fit(rows)
    stored = P.Preprocessor(["a"], ["b", "c", "d"], scale=True, max_categories=2).fit(rows)
    assert stored.sizes == {"b": 5, "c": 3} and stored.modes == held.modes and not stored.labels

    def features(prep):
        return sorted((str(r["_k"]), r["features"].toArray().tolist()) for r in prep.transform(both.withColumn("_k", F.to_json(F.struct("*"))), ["_k"]).collect())
    assert features(held) == features(stored)
    spec = P.Spec(["a"], ["b", "c"], "y", "ridge")
    plain = P.fit(rows, spec, {"alpha": 1.0}).predict(both)
    monkeypatch.setattr(P, "Preprocessor", partial(P.Preprocessor, max_categories=2))
    model = P.fit(rows, spec, {"alpha": 1.0})
    model.save(str(tmp_path / "model"))
    again = P.FittedModel.load(spark, str(tmp_path / "model"))
    want = sorted(r["prediction"] for r in plain.collect())
    for m in (model, again):
        assert np.allclose(sorted(r["prediction"] for r in m.predict(both).collect()), want)
    monkeypatch.undo()
    many = spark.range(30_000).select(F.concat(F.lit("n"), F.col("id") % 15_000).alias("b"), (F.col("id") % 3).cast("double").alias("a"))
    wide = P.Preprocessor(["a"], ["b"]).fit(many)
    assert wide.sizes == {"b": 15_000}
    row = wide.transform(many).where("b = 'n77'").select("features").first()["features"]
    assert row.size == 15_001 and row.numNonzeros() == 2


def test_a_linear_model_as_an_expression(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(rng.normal()) if i % 7 else None, float(i % 5 + 1), ["a", "b", None, "c"][i % 4], float(rng.normal() + 3 * (i % 4)), ["a", "new", None][i % 3]) for i in range(200)]
    df = spark.createDataFrame(rows, "run_key long, x double, units double, k string, y double, other string")
    for spec in (P.Spec(["x", "units"], ["k"], "y", unit="units"), P.Spec(["x"], ["k"], "y", "elastic_net"), P.Spec(["units"], [], "y")):
        model = P.fit(df, spec, {"alpha": 0.5, "l1_ratio": 0.5})
        want = {r["run_key"]: r["prediction"] for r in model.predict(df.withColumn("k", F.col("other"))).collect()}
        got = {r["run_key"]: r["p"] for r in df.select("run_key", model.linear({"k": F.col("other")}).alias("p")).collect()}
        assert got == pytest.approx(want, rel=1e-9)
    assert P.fit(df, P.Spec(["x"], [], "y", "forest"), {"numTrees": 2}).linear({}) is None


def test_inner_search_reads_each_row_once(data, monkeypatch):
    from plumbline.plans import gram
    seen, sums = [], gram.part_sums
    monkeypatch.setattr(gram, "part_sums", lambda rows, parts, basis: seen.append(rows.count()) or sums(rows, parts, basis))
    _, meta = P.nested_cv(data, "fold", "g", SPEC, [{"alpha": 1e6}, {"alpha": 0.1}])
    assert seen == [data.count()] and all(r["selected"] == 1 for r in meta.collect())


def test_one_candidate_needs_no_inner_folds(data, monkeypatch):
    monkeypatch.setattr(P, "inner_manifest", lambda *a: pytest.fail("inner folds dealt"))
    _, meta = P.nested_cv(data, "fold", "g", SPEC, [{"alpha": 0.1}])
    assert all(r["selected"] == 0 and r["scores"] == [None] for r in meta.collect())


def test_inner_folds_are_those_of_each_training_part(data):
    got = {(r["_set"], r["g"], r["_inner"]) for r in P.inner_manifest(data, "fold", "g", P.fold_values(data, "fold"), 3, 5).collect()}
    want = {(k, r["g"], r["_inner"]) for k in P.fold_values(data, "fold") for r in group_folds(data.where(F.col("fold") != k), "g", 3, 5, "_inner").collect()}
    assert got == want


def test_permuted_rows_are_not_sent_to_every_executor(data):
    """Rows of all repeats have the estimated size of one, so a join that may broadcast them takes many times the limit through the driver."""
    found = P.permutation_importance(P.fit(data, SPEC, {"alpha": 1.0}), data, ["run_key"], repeats=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_d#" in plan and "BroadcastHashJoin [_d#" not in plan
    assert {r["feature"]: r["repeats"] for r in found.collect()} == {"a": 3, "b": 3, "c": 3}
