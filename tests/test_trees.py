"""Trees of all held-out parts from histograms against MLlib fits of each training part."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.splits import group_folds
from plumbline.plans import models as P
from plumbline.plans import trees


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """Few values a column, so that MLlib's thresholds are exact too; nulls, and a category of one fold."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        a, b, c = int(rng.integers(0, 9)), int(rng.integers(0, 30)), ["u", "v", "w"][i % 3] if i % 13 else "only here"
        rows.append((i, f"g{i % 13}", a, None if i % 17 == 0 else b / 7, None if i % 29 == 0 else c, 1 + i % 4, float(20 + 3 * a + 2 * b + 5 * (c == "w") + a * b / 9 + rng.normal())))
    path = str(tmp_path_factory.mktemp("data") / "t")
    spark.createDataFrame(rows, "run_key int, g string, a int, b double, c string, n int, y double").write.parquet(path)
    df = spark.read.parquet(path)
    return df.join(group_folds(df, "g", 2, 1).select("g", "fold"), "g").localCheckpoint()


SPEC = P.Spec(["a", "b"], ["c"], "y", "boosted")


@pytest.mark.parametrize("spec", [replace(SPEC, objective="absolute", weighted=True), replace(SPEC, unit="n", transform="log1p")])
def test_boosting_equals_fits_one_by_one(data, spec, monkeypatch):
    params, want = {"maxIter": 3, "maxDepth": 3}, {}
    for k in range(2):
        model = P.fit(data.where(F.col("fold") != k), spec, params)
        want.update({r["run_key"]: r["prediction"] for r in model.predict(data.where(F.col("fold") == k)).collect()})
    monkeypatch.setattr(P, "fit", None)  # no part is fitted on its own
    out = P.oof_fixed(data, "fold", spec, params)
    assert out.drop("prediction").dtypes == data.dtypes
    got = {r["run_key"]: r["prediction"] for r in out.collect()}
    assert got.keys() == want.keys() and np.allclose([got[i] for i in want], list(want.values()), rtol=1e-9)


def test_forest_averages_bootstrapped_trees(data, monkeypatch):
    monkeypatch.setattr(P, "fit", None)
    spec, params = replace(SPEC, algorithm="forest"), {"numTrees": 40, "maxDepth": 4, "featureSubsetStrategy": "all"}
    got = P.oof_fixed(data, "fold", spec, params).toPandas()
    again = P.oof_fixed(data, "fold", spec, params).toPandas()
    assert len(got) == 400 and np.corrcoef(got.prediction, got.y)[0, 1] > 0.9
    assert np.allclose(got.sort_values("run_key").prediction, again.sort_values("run_key").prediction)


def test_sums_in_groups_of_trees_are_the_same(data, monkeypatch):
    spec, params = replace(SPEC, algorithm="forest"), {"numTrees": 6, "maxDepth": 2}
    whole = P.oof_fixed(data, "fold", spec, params).toPandas().set_index("run_key").prediction
    monkeypatch.setattr(trees, "HELD", 1)
    parts = P.oof_fixed(data, "fold", spec, params).toPandas().set_index("run_key").prediction
    assert np.allclose(whole.sort_index(), parts.sort_index())


def test_draws_are_poisson_of_mean_one():
    w = trees.draws(np.arange(40_000), np.arange(4, 14), 5)
    share = np.bincount(w.ravel(), minlength=4)[:4] / w.size
    assert np.allclose(share, np.exp(-1.0) / np.array([1, 1, 2, 6]), atol=0.004)
    assert np.abs(np.corrcoef(w.T.astype(float)) - np.eye(10)).max() < 0.03
    assert (trees.draws(np.arange(40_000), np.arange(0, 14), 5)[:, 4:] == w).all()


def test_strategies_share_the_stored_rows(data, monkeypatch):
    plan = [{"objective": "squared", "weighted": False, "strategy_id": "s"}, {"objective": "absolute", "weighted": True, "strategy_id": "w"}]
    bins, calls = trees.find_bins, []
    monkeypatch.setattr(trees, "find_bins", lambda *a: calls.append(1) or bins(*a))
    out = P.run_strategies(data, "fold", SPEC, plan, {"maxIter": 2, "maxDepth": 2}).groupBy("strategy_id").agg(F.count("prediction").alias("n"))
    assert {r["strategy_id"]: r["n"] for r in out.collect()} == {"s": 400, "w": 400} and len(calls) == 1


def test_rounds_in_one_pass_equal_passes_a_level(data, monkeypatch):
    spec, params = replace(SPEC, objective="absolute"), {"maxIter": 4, "maxDepth": 2}
    grow, calls = trees._grow, []
    monkeypatch.setattr(trees, "_grow", lambda *a, **k: calls.append(1) or grow(*a, **k))
    quick = P.oof_fixed(data, "fold", spec, params).toPandas().set_index("run_key").prediction.sort_index()
    assert not calls
    monkeypatch.setattr(trees, "MOST_CELLS", 0)
    slow = P.oof_fixed(data, "fold", spec, params).toPandas().set_index("run_key").prediction.sort_index()
    assert len(calls) == 4 and len(quick) == 400 and np.allclose(quick, slow, rtol=1e-9)


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_open_leaves_equal_a_walk(depth):
    rng = np.random.default_rng(depth)
    grown = trees.Trees.empty(2, 30, depth, 3)
    grown.value[:] = rng.normal(size=grown.value.shape)
    for n in range(1, 1 << depth):
        split = (rng.random((2, 30)) < 0.8) & ((n == 1) | (grown.feature[:, :, n // 2] >= 0))
        grown.feature[:, :, n] = np.where(split, rng.integers(0, 5, (2, 30)), -1)
        grown.at[:, :, n] = rng.integers(0, 6, (2, 30))
    x, weights = rng.integers(0, 7, (500, 5)).astype(np.int32), rng.random(30)
    node = grown.nodes(1, np.arange(30), x, depth)
    assert np.allclose(grown.predict(1, x, weights), grown.value[1][np.arange(30), node] @ weights, rtol=1e-12)


def test_boosted_predictions_use_all_rounds(monkeypatch):
    from plumbline.catalog import modeling
    seen = []
    monkeypatch.setattr(modeling, "model_rows", lambda *a: None)
    monkeypatch.setattr(modeling, "scored", lambda *a: None)
    monkeypatch.setattr(modeling.P, "oof_gbt", lambda *a, **params: seen.append(params))
    modeling.oof_gbt(None, None)
    assert seen[0]["maxIter"] >= 200


def test_strategies_use_all_rounds(monkeypatch):
    from plumbline.catalog import modeling
    seen = []
    monkeypatch.setattr(modeling, "model_rows", lambda *a: None)
    monkeypatch.setattr(modeling, "scored", lambda *a: None)
    monkeypatch.setattr(modeling.P, "run_strategies", lambda df, fold, spec, plan, params: seen.append((len(plan), params)))
    modeling.run_strategies(None, None)
    assert seen[0][0] == 3 and seen[0][1]["maxIter"] >= 200
