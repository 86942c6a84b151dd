"""Whitening against numpy's eigenvectors and exact integers: nulls, odd entries and lengths, ties, clusters, missing rank."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import whitening
from plumbline.llm.queries import QUERIES


def matrices():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    yield "random", (lambda x: x @ x.T)(rng.normal(size=(30, 50)))
    yield "clusters", q @ np.diag([9.0] * 10 + [9 + 1e-9] * 5 + [3.0] * 5 + list(np.linspace(1, 2, 20))) @ q.T
    yield "identity", np.eye(12)
    yield "diagonal", np.diag(np.arange(1.0, 9))
    yield "low_rank", (lambda x: x @ x.T)(rng.normal(size=(20, 3)))
    yield "graded", (lambda d: np.outer(d, d) * (np.eye(16) + 0.1))(10.0 ** -np.arange(0, 4, 0.25))
    yield "one", np.array([[4.0]])
    yield "two", np.array([[2.0, 1.0], [1.0, 2.0]])


@pytest.mark.parametrize("name,a", list(matrices()), ids=[n for n, _ in matrices()])
def test_leading_components(name, a):
    a = (a + a.T) / 2
    values, vectors = whitening.leading_components(a, 8)
    want = np.linalg.eigvalsh(a)[::-1]
    want = want[want > 1e-12 * want.sum()][:8]
    assert np.allclose(values, want, rtol=1e-9, atol=1e-13 * want[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * want[0]


def test_sturm_counts():
    rng = np.random.default_rng(1)
    d, e = rng.normal(size=25), rng.normal(size=24)
    e[10] = 0
    own = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    x = np.linspace(-4, 4, 57)
    assert (whitening.count_below(d, e, x, 1e-300) == (own[None, :] < x[:, None]).sum(axis=1)).all()
    dd, ee, back = whitening.tridiagonal(np.diag(d))
    assert (dd == d).all() and not ee.any() and back == [None] * 23


def brute(vectors, components):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors])
    n, sums = len(x), [sum(int(r[j]) for r in x) for j in range(x.shape[1])]
    t = [[n * int(v) - s for v, s in zip(r, sums)] for r in x]
    z = np.array([[v / n for v in r] for r in t])
    e, q = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-e)[:components]
    return n, [sum(v * v for v in r) for r in t], z @ q[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(8)
    mix = rng.normal(size=(6, 6)) * [5, 3, 2, 1, 0.5, 0.2]
    good = [[float(c) for c in rng.normal(size=6) @ mix] for _ in range(200)]
    rows = [(i if i % 9 else None, v, "z") for i, v in enumerate(good)] + [(7, good[7], "z")]
    odd = [(900, None, "z"), (901, [], "z"), (902, [1.0, None, 2.0, 3.0, 4.0, 5.0], "z"), (903, [float("nan")] * 6, "z"), (904, [float("inf")] * 6, "z"), (905, [1.0] * 3, "z")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, component string").withColumns({c: F.lit("z") for c in ("vector", "x", "d", "at", "whitened")})
    out = whitening.whiten(df.repartition(5), components=4, keep=["vec_id", "x"]).toPandas()
    n, deviation, w, explained = brute([r[1] for r in rows], 4)
    assert len(out) == 4 * n and (out.n == n).all() and set(out.x) == {"z"} and out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9
    got = {}
    for r in out.itertuples():
        got.setdefault((r.deviation, round(abs(r.whitened), 7), r.component, round(r.explained, 9)), []).append(r.vec_id)
    want = {}
    for i, (r, dev) in enumerate(zip(rows, deviation)):
        for k in range(4):
            want.setdefault((dev, round(abs(w[i, k]), 7), k + 1, round(explained[k], 9)), []).append(r[0])
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    signs = out.sort_values("deviation").groupby("component").whitened.apply(lambda s: float(np.sign(s.iloc[0])))
    first = int(np.argmin(deviation))
    for k in range(4):
        own = out[out.component == k + 1].set_index("deviation").whitened
        flip = signs[k + 1] * np.sign(w[first, k])
        assert all(abs(np.atleast_1d(own[d])[0] - flip * w[i, k]) < 1e-8 for i, d in enumerate(deviation))


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [2.0, 3.0])], [(i, [0.5, -0.5]) for i in range(9)], [(1, [])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert whitening.whiten(df).count() == 0 and whitening.whiten(df).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_huge_entries_and_sums(spark):
    rows = [(i, [1e30 * (-1) ** i, float(i), 1e-30]) for i in range(20)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert out.deviation.isna().all() and np.isfinite(out.whitened).all() and out.identity_error[0] < 1e-6
    x = np.array([[1 << 40, 3], [-(1 << 40), 5]])
    assert whitening.deviations(x, (2, np.array([0, 4]), np.array([0, 0]))) == [None, None]


def test_query(spark, sf):
    out = QUERIES["op11_whitening"](spark, sf).toPandas()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    n, deviation, w, explained = brute(table.embedding, 32)
    assert len(out) == 32 * n and out.identity_error[0] < 1e-9
    wide = out.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert np.abs(np.abs(wide) - np.abs(w)).max() < 1e-7
    assert (out.drop_duplicates("vec_id").sort_values("vec_id").deviation == deviation).all()
    assert np.allclose(out.drop_duplicates("component").sort_values("component").explained, explained, rtol=1e-9)
