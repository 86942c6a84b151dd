"""Group-isolated splits, random splits, holdouts and mean baselines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import restore_target, transform_target
from plumbline.operators.joins import except_keys, only_keys
from plumbline.operators.ordering import hash_index, row_index
from plumbline.operators.ranking import hash_pick


def serpentine(index, k):
    """0..k-1, k-1..0, 0..k-1, …: neighbours in size order land in different folds."""
    k = F.lit(k) if isinstance(k, int) else k
    place = index % k
    return F.when(F.floor(index / k) % 2 == 0, place).otherwise(k - 1 - place).cast("int")


def group_folds(df: DataFrame, group: str, k: int = 5, seed: object = 0, name: str = "fold", by: Sequence[str] = (), rows: Column | None = None) -> DataFrame:
    """Manifest (by…, group, n_rows, fold): groups dealt serpentine in order of size, ties in md5 order; within each value of ``by``.

    A group's position is the number of larger groups (offsets over the distinct
    sizes, of which there are fewer than sqrt(2 * rows)) plus its hash position
    among groups of its size; no task sees all groups.  ``rows`` is the number of rows that a row stands for.
    """
    by = list(by)
    sizes = df.groupBy(*by, group).agg((F.count("*") if rows is None else F.sum(rows)).alias("n_rows"))
    levels = sizes.groupBy(*by, "n_rows").agg(F.count("*").alias("_g"))
    every = Window.partitionBy(*(by or [F.lit(0)]))
    larger = every.orderBy(F.col("n_rows").desc()).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select(*by, "n_rows", F.coalesce(F.sum("_g").over(larger), F.lit(0)).alias("_off"), F.sum("_g").over(every).alias("_n"))
    placed = hash_index(sizes, [group], seed, by=[*by, "n_rows"], name="_i").join(F.broadcast(levels), [*by, "n_rows"])
    folds = F.least(F.lit(k), F.col("_n").cast("int"))
    return placed.select(*by, group, "n_rows", serpentine(F.col("_off") + F.col("_i"), folds).alias(name))


def leave_group_out(df: DataFrame, group: str, name: str = "fold") -> DataFrame:
    """Manifest (group, n_rows, fold): one fold per value in sorted order."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n_rows"))
    return row_index(sizes, [group], name=name)


def leave_group_within(df: DataFrame, slice_col: str, group: str, min_groups: int = 3, name: str = "fold") -> DataFrame:
    """Manifest (slice, group, n_rows, fold) for slices that hold at least ``min_groups`` groups."""
    cells = df.groupBy(slice_col, group).agg(F.count("*").alias("n_rows"))
    wide = cells.groupBy(slice_col).agg(F.count("*").alias("_g")).where(F.col("_g") >= min_groups)
    return row_index(only_keys(cells, wide, slice_col), [group], by=[slice_col], name=name)


def random_splits(df: DataFrame, key: str, test: float = 0.2, repeats: int = 10, seed: object = 0) -> DataFrame:
    """(key, repeat, is_test): exactly ceil(test * n) test rows per repeat, chosen by md5 order.

    Bucket counts of the hash find the one bucket that holds the cut, and only
    that bucket's rows are ranked; every other row is decided by comparing its
    hash with one threshold per repeat, without a shuffle.
    """
    reps = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")
    rows = df.select(F.col(key), reps)
    rows = rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("repeat").cast("string"), F.col(key).cast("string"))))
    rows = rows.withColumn("_b", F.substring("_h", 1, 4))
    counts = rows.groupBy("repeat", "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("repeat")
    placed = counts.withColumns({
        "_before": F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_target": F.ceil(F.lit(test) * F.sum("_n").over(w))})
    edge = placed.where((F.col("_before") < F.col("_target")) & (F.col("_target") <= F.col("_before") + F.col("_n")))
    # one row per repeat
    edge = edge.select("repeat", "_b", (F.col("_target") - F.col("_before")).alias("_need"))
    near = rows.join(F.broadcast(edge), ["repeat", "_b"])
    order = Window.partitionBy("repeat").orderBy("_h", key)
    cut = near.withColumn("_i", F.row_number().over(order)).where(F.col("_i") == F.col("_need"))
    cut = cut.select("repeat", F.col("_h").alias("_ch"), F.col(key).alias("_ck"))
    joined = rows.join(F.broadcast(cut), "repeat", "left")
    is_test = (F.col("_h") < F.col("_ch")) | ((F.col("_h") == F.col("_ch")) & (F.col(key) <= F.col("_ck")))
    return joined.select(key, "repeat", F.coalesce(is_test, F.lit(False)).alias("is_test"))


def lock_holdout(df: DataFrame, group: str, ident: str, seed: object) -> tuple[DataFrame, DataFrame]:
    """(development, confirmatory): per group with several ids, one id's rows are held out by hash."""
    picked = hash_pick(df, group, ident, seed).select(ident)
    return except_keys(df, picked, ident), only_keys(df, picked, ident)


def holdout_flags(df: DataFrame, group: str, ident: str, seed: object) -> DataFrame:
    """(ident, is_holdout) per distinct id."""
    picked = hash_pick(df, group, ident, seed).select(ident, F.lit(True).alias("is_holdout"))
    return df.select(ident).distinct().join(picked, ident, "left").withColumn(
        "is_holdout", F.coalesce("is_holdout", F.lit(False)))


def isolation(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups, and groups that occur in more than one fold."""
    per_group = df.groupBy(group).agg(F.min(fold).alias("_lo"), F.max(fold).alias("_hi"))
    return per_group.agg(F.count("*").alias("n_groups"), F.count_if(F.col("_lo") != F.col("_hi")).alias("n_crossing"))


def assert_isolated(df: DataFrame, group: str, fold: str) -> None:
    n = isolation(df, group, fold).first()["n_crossing"]
    if n:
        raise ValueError(f"{n} groups cross folds")


def oof_mean(df: DataFrame, y: str, fold: str, unit: str | None = None, transform: str = "raw",
             name: str = "prediction") -> DataFrame:
    """Out-of-fold mean baseline: (S - S_f) / (N - N_f) of the (transformed, per-unit) target."""
    return oof_means(df, y, fold, {name: (unit, transform)})


def oof_means(df: DataFrame, y: str, fold: str, strategies: Mapping[str, tuple[str | None, str]]) -> DataFrame:
    """Mean baselines for several (unit, transform) strategies, one prediction column each.

    One aggregation by fold replaces a fit per fold and strategy; the k fold rows
    are broadcast.
    """
    parts = {name: (F.col(unit) if unit else None, transform) for name, (unit, transform) in strategies.items()}
    targets = [transform_target(F.col(y), transform, u) for u, transform in parts.values()]
    folds = df.groupBy(fold).agg(*[x for i, t in enumerate(targets) for x in (F.sum(t).alias(f"_s{i}"), F.count(t).alias(f"_n{i}"))])
    every = Window.partitionBy(F.lit(0))  # one row per fold
    means = folds.select(fold, *[
        ((F.sum(f"_s{i}").over(every) - F.col(f"_s{i}")) / F.nullif(F.sum(f"_n{i}").over(every) - F.col(f"_n{i}"), F.lit(0))).alias(f"_m{i}")
        for i in range(len(parts))])
    joined = df.join(F.broadcast(means), fold)
    restored = {name: restore_target(F.col(f"_m{i}"), transform, u) for i, (name, (u, transform)) in enumerate(parts.items())}
    return joined.withColumns(restored).drop(*[f"_m{i}" for i in range(len(parts))])


