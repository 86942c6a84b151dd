"""Quantile bins, per-group picks, running totals, ranks and representative samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.joins import join_many_to_one
from plumbline.operators.ordering import hash_text, quantile_table, running_total
from plumbline.session import cut_lineage


def bin_of(value: Column, edges: Sequence[Column]) -> Column:
    """1-based right-closed bin: one more for every distinct inner edge below the value; ties never split."""
    steps = [F.when((inner > below) & (value > inner), 1).otherwise(0) for below, inner in zip(edges, edges[1:-1])]
    return F.when(value.isNotNull(), sum(steps, F.lit(1))).cast("int")


def qcut(df: DataFrame, col: str, n: int, by: Sequence[str] = (), name: str = "bin", **kw: object) -> DataFrame:
    """Bins by exact linear quantile edges: right-closed, lowest value included, duplicate edges dropped."""
    probs = [i / n for i in range(n + 1)]
    edges = quantile_table(df, [col], probs, by, **kw).select(*by, F.col("q").alias("_q"))
    joined = join_many_to_one(df, edges, by, null_safe=True) if by else df.withColumn("_q", edges.scalar())
    return joined.withColumn(name, bin_of(F.col(col), [F.col("_q")[i] for i in range(n + 1)])).drop("_q")


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Top row per group.  Spark limits ranks before the shuffle, so a hot group stays cheap."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def hash_pick(df: DataFrame, group: str, ident: str, seed: object, min_ids: int = 2) -> DataFrame:
    """For groups with several ids: the id with the smallest sha256(seed|group|id); no other column is read."""
    ids = df.select(group, ident).distinct()
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string"), F.col(ident).cast("string")), 256)
    return ids.groupBy(group).agg(F.count("*").alias("n_ids"), F.min_by(F.col(ident), h).alias(ident)).where(
        F.col("n_ids") >= min_ids)


def cumulative(df: DataFrame, order: str, value: str, by: Sequence[str] = (), **kw: object) -> DataFrame:
    """Running sum up to and including each row, and its share of the group's total."""
    out = running_total(df, [order], F.col(value), by, before="_before", total="_total", **kw)
    running = F.col("_before") + F.col(value)
    return out.withColumn("cumulative", running).withColumn(
        "cumulative_share", F.try_divide(running.cast("double"), F.col("_total").cast("double"))).drop("_before", "_total")


def value_ranks(df: DataFrame, col: str, by: Sequence[str] = (), **kw: object) -> DataFrame:
    """(by…, value, n, avg_rank): average ranks computed on the value histogram."""
    hist = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col)).agg(F.count("*").alias("n"))
    placed = running_total(hist, [col], F.col("n"), by, before="_before", **kw)
    return placed.select(*by, col, "n", (F.col("_before") + (F.col("n") + 1) / 2.0).alias("avg_rank"))


def avg_rank(df: DataFrame, col: str, by: Sequence[str] = (), name: str = "avg_rank", **kw: object) -> DataFrame:
    """Average rank of each row (ties share the mean of their positions)."""
    ranks = value_ranks(df, col, by, **kw).select(*by, col, F.col("avg_rank").alias(name))
    return join_many_to_one(df, ranks, [*by, col], null_safe=True)


def bias_by_bin(df: DataFrame, y: str, residual: str, n: int = 10, **kw: object) -> DataFrame:
    """Rows, mean and median residual per quantile bin of the target."""
    binned = qcut(df, y, n, name="bin", **kw)
    mean = binned.groupBy("bin").agg(F.count("*").alias("n_rows"), F.avg(residual).alias("mean_residual"))
    median = quantile_table(binned, [residual], [0.5], ["bin"], **kw).select("bin", F.col("q")[0].alias("median_residual"))
    return mean.join(median, "bin")


def ordered(df: DataFrame, keys: Sequence[str], descending: Sequence[str] = ()) -> DataFrame:
    """Deterministic multi-key sort, nulls last."""
    return df.orderBy(*[F.col(k).desc_nulls_last() if k in descending else F.col(k).asc_nulls_last() for k in keys])


def bounded_examples(df: DataFrame, keys: Sequence[str], n: int, descending: Sequence[str] = ()) -> DataFrame:
    """The first n rows of a deterministic order (top-n per partition, then one small merge)."""
    return ordered(df, keys, descending).limit(n)


def curves(df: DataFrame, fold: str, x: str, y: str) -> DataFrame:
    """Curve points with their position inside each fold, never joined across folds."""
    points = df.groupBy(fold, x).agg(F.avg(y).alias(y))
    placed = running_total(points, [x], F.lit(1).cast("bigint"), [fold], before="position")
    return placed.select(fold, "position", x, y)


def sample_n(df: DataFrame, key: Sequence[str], n: int, seed: object, exact: bool = True) -> DataFrame:
    """The n rows with the smallest md5(seed|key): seeded, repeatable; fails when fewer exist."""
    picked = df.withColumn("_h", hash_text(seed, *key)).orderBy("_h", *key).limit(n)
    if exact:
        have = picked.agg(F.count("*").alias("n")).scalar()
        enough = F.when(have == n, F.lit(True)).otherwise(F.raise_error(F.lit(f"fewer than {n} rows to sample")))
        picked = picked.where(enough)
    return picked.drop("_h")


def facet_table(df: DataFrame, facets: dict[str, Column], key: Sequence[str]) -> DataFrame:
    """One row per distinct facet combination with the smallest key that has it and its row count."""
    labelled = df.select(*key, *[F.concat(F.lit(f"{n}:"), c.cast("string")).alias(n) for n, c in facets.items()])
    return labelled.groupBy(*facets).agg(F.min(F.struct(*key)).alias("_key"), F.count("*").alias("n_rows"))


def representative_sample(df: DataFrame, facets: dict[str, Column], key: Sequence[str], weighted: str,
                          limit: int = 12, minimum: int = 9, weight: int = 3) -> DataFrame:
    """Greedy facet cover: each round takes the row that adds most uncovered facets.

    Score = new facets + ``weight`` for a new facet of the ``weighted`` kind, then
    new facets, then the smallest key.  Rows with the same facets are
    interchangeable until nothing is left to gain, so the rounds (at most
    ``limit``) run on the combination table; the driver holds only the covered
    facets, at most ``limit * len(facets)`` of them.  When every facet is covered,
    rows with the smallest keys fill up to ``minimum``.
    Result: key columns, round, gained (new facets, sorted).
    """
    minimum = min(minimum, limit)
    names = list(facets)
    combos = cut_lineage(facet_table(df, facets, key))
    covered: list[str] = []
    picked: list[tuple] = []
    while len(picked) < limit:
        seen = F.array(*[F.lit(x) for x in covered]) if covered else F.array().cast("array<string>")
        gained = F.array_sort(F.array_except(F.array(*names), seen))
        bonus = F.lit(weight) * F.when(F.array_contains(seen, F.col(weighted)), 0).otherwise(1)
        best = combos.select("_key", *names, gained.alias("gained")).withColumn("_n", F.size("gained")).orderBy(
            (F.col("_n") + bonus).desc(), F.col("_n").desc(), F.col("_key").asc()).first()
        if best is None or best["_n"] == 0:
            break
        picked.append((tuple(best["_key"]), best["gained"]))
        covered += [best[n] for n in names if best[n] not in covered]
    if len(picked) < minimum:
        taken = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(key, p)]) for p, _ in picked])
        rest = df.select(*key).where(~F.array_contains(taken, F.struct(*key))) if picked else df.select(*key)
        picked += [(tuple(r), []) for r in rest.orderBy(*key).limit(minimum - len(picked)).collect()]
    rows = [(*p, i + 1, list(g)) for i, (p, g) in enumerate(picked)]
    schema = ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key], "round int", "gained array<string>"])
    return df.sparkSession.createDataFrame(rows, schema)


def cover_manifest(df: DataFrame, selected: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """Available facets, each with whether a selected row covers it."""
    def facet_rows(x: DataFrame) -> DataFrame:
        labels = F.array(*[F.concat(F.lit(f"{n}:"), c.cast("string")) for n, c in facets.items()])
        return x.select(F.explode(labels).alias("facet")).where(F.col("facet").isNotNull())
    available = facet_rows(df).groupBy("facet").agg(F.count("*").alias("n_rows"))
    covered = facet_rows(selected).distinct().withColumn("covered", F.lit(True))
    return available.join(covered, "facet", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))

