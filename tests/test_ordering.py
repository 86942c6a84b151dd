"""The distributed order statistics against brute force."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import ordering as O
from plumbline.operators import ranking as W
from plumbline.operators import splits as T


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value and one group; some values are null."""
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"g{i % 7}", 5.0 if i % 3 == 0 else (None if i % 11 == 0 else float(rng.choice([rng.random() * 100, rng.randint(0, 9)]))), i)
            for i in range(3000)] + [("void", None, 3000 + i) for i in range(3)]
    return pd.DataFrame(rows, columns=["g", "v", "k"]), spark.createDataFrame(rows, "g string, v double, k long").repartition(5)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_equal_numpy(skewed, by):
    pdf, df = skewed
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {tuple(r[b] for b in by): r for r in O.quantile_table(df, ["v"], probs, by).collect()}
    groups = pdf.groupby("g") if by else [((), pdf)]
    for name, part in groups:
        row = got[(name,) if by else ()]
        values = part.v.dropna().to_numpy()
        assert row["n"] == len(values)
        if len(values):
            assert np.allclose(row["q"], np.quantile(values, probs))
        else:
            assert row["q"] is None or row["q"] == []


@pytest.mark.parametrize("by", [[], ["h"]])
def test_quantiles_without_each_group(skewed, by):
    pdf, df = skewed
    pdf, df = pdf.assign(h=pdf.k % 2), df.withColumn("h", F.col("k") % 2)
    for r in O.quantile_table(df, ["v"], [0.1, 0.5], by, leave_out="g").collect():
        own = pdf[(pdf.g != r["g"]) & ((pdf.h == r["h"]) if by else True)].v.dropna()
        assert r["n"] == len(own) and np.allclose(r["q"], np.quantile(own, [0.1, 0.5]))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12, 97, 1000])
def test_keyed_permutations(spark, n):
    rows = spark.range(n).crossJoin(spark.range(3).withColumnRenamed("id", "r")).select("id", "r", O.permuted(F.col("id"), n, 7, F.col("r")).alias("p")).toPandas()
    assert all(sorted(own.p) == list(range(n)) for _, own in rows.groupby("r"))
    if n == 1000:
        wide = rows.pivot(index="id", columns="r", values="p").to_numpy()
        assert max(abs(np.corrcoef(np.c_[np.arange(n), wide].T)[np.triu_indices(4, 1)])) < 0.12 and (wide[:, 0] == np.arange(n)).sum() < 10


def test_weighted_median(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 1), (10.0, 4), (3.0, 0)], "v double, w long")
    got = O.quantile_table(df, ["v"], [0.5], weight="w").first()
    assert got["q"] == [np.median([1] * 5 + [2] + [10] * 4)]


def test_running_total(skewed):
    pdf, df = skewed
    out = O.running_total(df, ["k"], F.lit(2).cast("bigint"), ["g"], before="b", total="t").toPandas().sort_values("k")
    want = pdf.sort_values("k").groupby("g").cumcount() * 2
    assert list(out.b) == list(want)
    assert list(out.t) == list(pdf.sort_values("k").groupby("g").g.transform("size") * 2)


@pytest.mark.parametrize("digits", [1, 2, 5])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_hash_index(skewed, digits, by):
    pdf, df = skewed
    out = O.hash_index(df, ["k"], 9, by, digits=digits).toPandas()
    pdf = pdf.assign(h=[hashlib.md5(f"9|{k}".encode()).hexdigest() for k in pdf.k]).sort_values(["h", "k"])
    want = (pdf.groupby("g").cumcount() if by else pd.Series(range(len(pdf)), index=pdf.index))
    want = dict(zip(pdf.k, want))
    assert dict(zip(out.k, out["index"])) == want


def test_average_ranks(skewed):
    pdf, df = skewed
    out = W.value_ranks(df, "v", ["g"]).toPandas()
    want = pdf.dropna().assign(r=lambda x: x.groupby("g").v.rank()).groupby(["g", "v"]).r.first()
    assert {(r.g, r.v): r.avg_rank for r in out.itertuples()} == dict(want)


def test_qcut_equals_pandas(skewed):
    pdf, df = skewed
    out = W.qcut(df, "v", 5).toPandas().sort_values("k")
    want = pd.qcut(pdf.v, 5, labels=False, duplicates="drop") + 1
    assert list(out.bin.fillna(-1)) == list(want.fillna(-1))


def test_random_splits_are_exact(skewed):
    _, df = skewed
    out = T.random_splits(df, "k", 0.2, 4, 1).toPandas()
    assert list(out.groupby("repeat").is_test.sum()) == [601] * 4  # ceil(0.2 * 3003)
    assert len(out) == 4 * 3003
    for r, part in out.groupby("repeat"):
        order = sorted(part.k, key=lambda k: (hashlib.md5(f"1|{r}|{k}".encode()).hexdigest(), k))
        assert set(part.k[part.is_test]) == set(order[:601])


def test_group_folds_balance_and_isolate(skewed):
    _, df = skewed
    folds = T.group_folds(df, "g", 3, 5)
    assert folds.count() == df.select("g").distinct().count()
    T.assert_isolated(df.join(folds, "g"), "g", "fold")
    assert T.group_folds(df.where("g = 'hot'"), "g", 3, 5).select("fold").first()[0] == 0  # min(k, groups)
    again = {r["g"]: r["fold"] for r in T.group_folds(df.repartition(2), "g", 3, 5).collect()}
    assert again == {r["g"]: r["fold"] for r in folds.collect()}


def test_sample_n_fails_when_short(spark):
    df = spark.range(5)
    assert W.sample_n(df, ["id"], 5, 1).count() == 5
    with pytest.raises(Exception, match="fewer than 6"):
        W.sample_n(df, ["id"], 6, 1).collect()


def test_sort_keys_are_the_bits_of_doubles(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.abs(rng.normal(size=500)) * 10.0 ** rng.integers(-300, 300, 500), 2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1000, 1024), 0),
                             np.nextafter(2.0 ** np.arange(-1000, 1023), np.inf), [0.0, 1.7976931348623157e308, 5e-324, 2.2250738585072009e-308, float("inf")]])
    want = values.view(np.int64)
    rows = spark.createDataFrame(pd.DataFrame({"v": np.concatenate([values, -values]), "b": np.concatenate([want, -want])}))
    assert rows.where(O.sort_key(F.col("v")) != F.col("b")).count() == 0
    assert rows.where(O.sort_key(F.col("v")).isNull()).count() == 0


@pytest.mark.parametrize("leaf,cells", [(1 << 16, 1 << 16), (1, 1 << 16), (3, 4)])
def test_quantiles_of_values_close_together(spark, monkeypatch, leaf, cells):
    """Microsecond stamps, a few doubles apart, ties and a far value: cut again until a bucket is small, with the same result."""
    monkeypatch.setattr(O, "LEAF", leaf)
    monkeypatch.setattr(O, "CELLS", cells)
    rng = np.random.default_rng(5)
    a = np.concatenate([1.7e15 + rng.integers(0, 2000, 1500), np.full(400, 1.7e15 + 7), [1e300, -1e300]])
    b = np.concatenate([1 + rng.integers(0, 900, 1500) * 2.0 ** -52, -rng.random(400), [0.0, 0.0]])
    df = spark.createDataFrame(pd.DataFrame({"g": rng.integers(0, 3, 1902), "a": a, "b": b}))
    probs = [0.0, 0.01, 0.5, 0.77, 1.0]
    for by in ([], ["g"]):
        pdf = df.toPandas()
        for r in O.quantile_table(df, ["a", "b"], probs, by).collect():
            own = pdf[pdf.g == r["g"]] if by else pdf
            assert np.allclose(r["q"], np.quantile(own[r["column"]], probs), rtol=1e-15)


def test_no_task_orders_many_values(spark):
    """Stamps within one second of each other: what is left to order is a small part of them."""
    df = spark.range(300_000).select((F.lit(1.7e15) + F.col("id")).alias("v"))
    placed = df.select(O.sort_key(F.col("v")).alias("_k"), "v").select(F.lit("v").alias("column"), F.shiftright("_k", O.LEADING).alias("_b"), F.lit(0).cast("long").alias("_start"),
                                                                       F.lit(300_000).cast("long").alias("_n"), "_k", "v", F.lit(1).cast("long").alias("_c"))
    assert placed.select("_b").distinct().count() == 1
    assert O._refine(placed, ["column"], [0.1, 0.5]).count() < 300_000 * 0.01


def test_quantiles_of_one_exploded_group(spark):
    df = spark.range(300).select((F.col("id") / 7).alias("v"), F.explode(F.sequence(F.lit(1), F.lit(2000))).alias("i"))
    got = O.quantile_table(df.withColumn("g", F.lit("all")), ["v"], [0.1, 0.5], ["g"]).first()
    assert got["n"] == 600_000 and np.allclose(got["q"], np.quantile(np.repeat(np.arange(300) / 7, 2000), [0.1, 0.5]))


def test_a_permutation_hashes_each_digit_once(spark, monkeypatch):
    from hashlib import md5
    n, rows, width, calls = 1000, 32, 32, []
    monkeypatch.setattr(O, "md5", lambda b: calls.append(b) or md5(b))
    tables = O.permutation_tables(7, 2, rows, width)
    assert len(calls) == 2 * O.ROUNDS * 32  # not one for every row and turn

    def send(x):
        left, right = divmod(x, width)
        for k in range(2 * O.ROUNDS):
            h = lambda half, digit: int(md5(f"7|2|{half}|{k}|{digit}".encode()).hexdigest()[:8], 16)  # noqa: E731, B023
            if k % 2 == 0:
                left = (left + h("l", right) % rows) % rows
            else:
                right = (right + h("r", left) % width) % width
        x = left * width + right
        return x if x < n else send(x)
    got = [r[0] for r in spark.range(n).select("id", O.permuted(F.col("id"), n, 7, F.lit(2)).alias("p")).orderBy("id").select("p").collect()]
    assert got == [send(x) for x in range(n)] and len(tables) == 2 * O.ROUNDS


def test_quantiles_of_overlapping_sets(spark):
    rows = [(i % 4, float((i * 37) % 101) if i % 5 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "c int, x double")
    members = {0: {0, 1}, 1: {1, 2, 3}, 2: set()}
    def sets(own):
        return F.array(*[F.struct(F.lit(s).alias("_set"), (own[0].isin(*m) if m else F.lit(False)).alias("_in")) for s, m in members.items()])
    got = {r["_set"]: (r["n"], r["q"]) for r in O.quantile_table(df, ["x"], [0.25, 0.5], sets=(["c"], sets)).collect()}
    for s, m in members.items():
        values = [x for c, x in rows if c in m and x is not None]
        assert got[s][0] == len(values)
        assert (got[s][1] is None) if not values else np.allclose(got[s][1], np.quantile(values, [0.25, 0.5]))


def test_quantiles_of_overlapping_sets(spark, monkeypatch):
    """Ties, signs, infinities, nulls, values close together, and sets that share cells; by few and by many passes."""
    rng = np.random.default_rng(4)
    values = [*rng.normal(size=400).tolist(), *[0.0, -0.0, 3.0, 3.0, 3.0, float("inf"), float("-inf"), float("nan"), None, 5e-324], *(1 + np.arange(200) * 2.0 ** -52).tolist()]
    rows = [(i % 5 - 2, v, None if i % 5 == 4 else i / 7) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "cell long, v double, w double").repartition(3)
    members = {-2: [0], -1: [0, 1], 0: [0, 2], 1: [0, 1, 2], 2: [3]}
    probs = [0.0, 0.37, 0.5, 1.0]
    for near in (O.NEAR, 0):
        monkeypatch.setattr(O, "NEAR", near)
        got = O.quantiles_of_sets(df, "cell", members, ["v", "w"], probs)
        for s in range(4):
            for c in (0, 1):
                mine = sorted(r[1 + c] for r in rows if s in members[r[0]] and r[1 + c] is not None and r[1 + c] == r[1 + c])
                if not mine:
                    assert (s, c) not in got
                    continue
                n, q = got[s, c]
                at = [(len(mine) - 1) * p for p in probs]
                sides = [(mine[int(np.floor(x))], mine[int(np.ceil(x))], x - np.floor(x)) for x in at]
                assert n == len(mine) and q == [a if a == b else a + (b - a) * f for a, b, f in sides]
