"""Model-evaluation aggregates over prediction tables.

Means come from one aggregation; medians are quantiles and therefore go through
``quantile_table``, which never holds a large slice in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.numeric import EPS
from plumbline.operators import resample
from plumbline.operators.joins import join_many_to_one
from plumbline.operators.ordering import agg_with_medians, quantile_table, quantiles_of_sets
from plumbline.operators.profile import _null_safe_join
from plumbline.operators.ranking import bin_of, first_per_group, value_ranks
from plumbline.session import cut_lineage


def residual(y: str, p: str) -> Column:
    return F.col(p) - F.col(y)


def absolute_percentage_error(y: str, p: str, eps: float = EPS) -> Column:
    return F.abs(residual(y, p)) / F.greatest(F.abs(F.col(y)), F.lit(eps)) * 100.0


def _smape(y: str, p: str, eps: float) -> Column:
    return 200.0 * F.abs(residual(y, p)) / F.greatest(F.abs(F.col(y)) + F.abs(F.col(p)), F.lit(eps))


def mean_metrics(y: str, p: str, eps: float = EPS) -> dict[str, Column]:
    """Aggregates of M1 that need no order: mae, rmse, r2 (null when the target is constant), smape, signed bias."""
    r = residual(y, p)
    total = F.var_pop(y) * F.count(y)
    return {
        "n_rows": F.count("*"),
        "mae": F.avg(F.abs(r)),
        "rmse": F.sqrt(F.avg(r * r)),
        "r2": F.when(F.var_pop(y) > 0, 1 - F.sum(r * r) / F.nullif(total, F.lit(0.0))),
        "smape": F.avg(_smape(y, p, eps)),
        "signed_bias": F.avg(r),
    }


def per_unit_metrics(y: str, p: str, units: str) -> dict[str, Column]:
    r = F.try_divide(residual(y, p), F.col(units))
    return {
        "per_unit_mae": F.avg(F.abs(r)),
        "per_unit_rmse": F.sqrt(F.avg(r * r)),
        "per_unit_signed_bias": F.avg(r),
        "negative_predictions": F.count_if(F.col(p) < 0),
    }


def calibration_line(y: str, p: str) -> dict[str, Column]:
    """OLS of prediction on actual; null for fewer than two rows or a constant target."""
    usable = (F.count(y) > 1) & (F.var_pop(y) > 0)
    return {"calibration_slope": F.when(usable, F.regr_slope(p, y)),
            "calibration_intercept": F.when(usable, F.regr_intercept(p, y))}


def _grouped(df: DataFrame, by: Sequence[str], metrics: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[v.alias(k) for k, v in metrics.items()])


def regression_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = (), eps: float = EPS, **kw: object) -> DataFrame:
    """mae, rmse, r2, mdape %, smape %, signed bias per group (or for the whole table)."""
    return agg_with_medians(df, mean_metrics(y, p, eps), by, {"mdape": absolute_percentage_error(y, p, eps)}, **kw)


def metrics_per_unit(df: DataFrame, y: str, p: str, units: str, by: Sequence[str] = ()) -> DataFrame:
    return _grouped(df, by, {"n_rows": F.count("*"), **per_unit_metrics(y, p, units)})


def calibration(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return _grouped(df, by, {"n_rows": F.count("*"), **calibration_line(y, p)})


def slice_cells(df: DataFrame, y: str, dims: Mapping[str, str], quantiles: Mapping[str, float], n_bins: int | None = 4, by: Sequence[str] = (),
                bin_name: str = "target_quartile", **kw: object) -> tuple[DataFrame, list[str], Callable[[Mapping[str, Column]], Column]]:
    """(rows, cells, slices): columns that decide which slices a row belongs to, and what makes of them an array of (slice_type, slice_value).

    Thresholds and bin edges are exact quantiles of the target per ``by`` group,
    all found in one pass.
    """
    probs = [*quantiles.values(), *([i / n_bins for i in range(n_bins + 1)] if n_bins else [])]
    keep, tops = df.columns, {kind: f"_top{i}" for i, kind in enumerate(quantiles)}
    if probs:
        table = quantile_table(df, [y], probs, by, **kw).select(*by, F.col("q").alias("_thr"))
        df = join_many_to_one(df, table, by, null_safe=True) if by else df.withColumn("_thr", table.scalar())
    limits = [F.col("_thr")[i] for i in range(len(probs))]
    marks = [(F.col(y) >= limit).alias(name) for name, limit in zip(tops.values(), limits)]
    if n_bins:
        marks.append(bin_of(F.col(y), limits[len(quantiles):]).cast("string").alias("_bin"))

    def slices(col: Mapping[str, Column]) -> Column:
        entries = [F.struct(F.lit("overall").alias("slice_type"), F.lit("all").alias("slice_value"))]
        for kind, column in dims.items():
            entries.append(F.when(col[column].isNotNull(), F.struct(F.lit(kind).alias("slice_type"), col[column].cast("string").alias("slice_value"))))
        for kind, name in tops.items():
            entries.append(F.when(col[name], F.struct(F.lit(kind).alias("slice_type"), F.lit("tail").alias("slice_value"))))
        if n_bins:
            entries.append(F.struct(F.lit(bin_name).alias("slice_type"), F.concat(F.lit("Q"), col["_bin"]).alias("slice_value")))
        return F.array(*entries)
    return df.select(*keep, *marks), list(dict.fromkeys([*dims.values(), *tops.values(), *(["_bin"] if n_bins else [])])), slices


def _in_slices(rows: DataFrame, keep: Sequence[str], cells: Sequence[str], slices: Callable[[Mapping[str, Column]], Column]) -> DataFrame:
    # rows outside a slice give a null struct; inline stays in generated code where array_compact would not
    return rows.select(*keep, F.inline(slices({c: F.col(c) for c in cells}))).where(F.col("slice_type").isNotNull())


def slice_rows(df: DataFrame, y: str, dims: Mapping[str, str], quantiles: Mapping[str, float],
               n_bins: int | None = 4, by: Sequence[str] = (), bin_name: str = "target_quartile", **kw: object) -> DataFrame:
    """Each row once per slice it belongs to, as (slice_type, slice_value)."""
    rows, cells, slices = slice_cells(df, y, dims, quantiles, n_bins, by, bin_name, **kw)
    return _in_slices(rows, df.columns, cells, slices)


def error_slices(df: DataFrame, y: str, p: str, units: str, cluster: str, dims: Mapping[str, str],
                 quantiles: Mapping[str, float], n_bins: int | None = 4, by: Sequence[str] = (), eps: float = EPS,
                 **kw: object) -> DataFrame:
    """M1–M3 with median residual per slice; rows are stored once, not once a slice.

    Rows that lie in the same slices are a cell.  With few cells and slices, medians are found by counts that know the slices of each cell, and a cluster's slices are bits that add up;
    else both deal rows to the slices after adding up those of a cell.
    """
    by = list(by)
    found, cells, slices = slice_cells(df.select(*dict.fromkeys([*by, y, p, units, cluster, *dims.values()])), y, dims, quantiles, n_bins, by, **kw)
    rows, keys = cut_lineage(found), [*by, "slice_type", "slice_value"]
    metrics = {**mean_metrics(y, p, eps), **per_unit_metrics(y, p, units), **calibration_line(y, p)}
    out = _grouped(_in_slices(rows, dict.fromkeys([*by, y, p, units]), cells, slices), keys, metrics)

    def sets(own: Sequence[Column]) -> Column:
        return F.transform(slices(dict(zip(cells, own))), lambda s: F.struct(s.alias("_set"), s.isNotNull().alias("_in")))
    medians = {"mdape": absolute_percentage_error(y, p, eps), "residual_median": residual(y, p)}
    known = _known_cells(rows, by, cells, slices)
    if known is not None:
        return _joined_slices(out, *_slices_by_cell(rows, known, by, cluster, cells, medians), keys)
    table = quantile_table(rows.select(*dict.fromkeys([*by, *cells]), *[v.alias(k) for k, v in medians.items()]), list(medians), [0.5], by, sets=(cells, sets), **kw)
    wide = table.where(F.col("_set").isNotNull()).select(*by, "_set.*", "column", F.col("q")[0].alias("_m")).groupBy(*keys).agg(
        *[F.max(F.when(F.col("column") == k, F.col("_m"))).alias(k) for k in medians])
    held = rows.where(F.col(cluster).isNotNull()).select(*by, F.col(cluster).alias("_cluster"), *[F.col(c).alias(f"_of{i}") for i, c in enumerate(cells)]).distinct()
    held = held.select(*by, "_cluster", F.inline(slices({c: F.col(f"_of{i}") for i, c in enumerate(cells)}))).where(F.col("slice_type").isNotNull()).distinct()
    return _joined_slices(out, wide, held.groupBy(*keys).agg(F.count("*").alias("n_clusters")), keys)


def _joined_slices(out: DataFrame, wide: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _null_safe_join(_null_safe_join(out, wide, keys), sizes, keys, "left").withColumn("n_clusters", F.coalesce("n_clusters", F.lit(0)))


#: cells, and slices of all groups, up to which they are known to every task; bits of one number
MOST_CELLS, MOST_SLICES, BITS = 1 << 15, 256, 62


def _cell(by: Sequence[str], cells: Sequence[str]) -> Column:
    """A hash of the columns that decide a row's group and slices; a null counts."""
    return F.xxhash64(*[x for c in dict.fromkeys([*by, *cells]) for x in (F.col(c), F.col(c).isNull())])


def _known_cells(rows: DataFrame, by: Sequence[str], cells: Sequence[str], slices: Callable[[Mapping[str, Column]], Column]) -> list[Row] | None:
    """(``_cell``, groups, ``_slices``) of every cell; None for too many, or two of one hash."""
    found = rows.select(*dict.fromkeys([*by, *cells])).distinct().limit(MOST_CELLS + 1)
    own = F.filter(slices({c: F.col(c) for c in cells}), lambda s: s.isNotNull())
    known = found.select(_cell(by, cells).alias("_cell"), F.struct(F.lit(0), *by).alias("_group"), own.alias("_slices")).collect()
    few = len(known) <= MOST_CELLS and len({(tuple(r["_group"]), tuple(s)) for r in known for s in r["_slices"]}) <= MOST_SLICES
    return known if few and len({r["_cell"] for r in known}) == len(known) else None


def _slices_by_cell(rows: DataFrame, known: Sequence[Row], by: Sequence[str], cluster: str, cells: Sequence[str], medians: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Medians, and numbers of clusters, per group and slice."""
    spark, names = rows.sparkSession, {}
    of = {r["_cell"]: [names.setdefault((*tuple(r["_group"])[1:], *s), len(names)) for s in r["_slices"]] for r in known}
    marked = rows.withColumn("_cell", _cell(by, cells))
    found = quantiles_of_sets(marked.select("_cell", *[v.alias(k) for k, v in medians.items()]), "_cell", of, list(medians), [0.5])
    kinds = [*[rows.schema[c] for c in by], T.StructField("slice_type", T.StringType()), T.StructField("slice_value", T.StringType())]
    wide = spark.createDataFrame([(*name, *[found[i, j][1][0] if (i, j) in found else None for j in range(len(medians))]) for name, i in names.items()],
                                 T.StructType([*kinds, *[T.StructField(k, T.DoubleType()) for k in medians]]))
    words = [f"_w{w}" for w in range(-(-len(names) // BITS))]
    bits = spark.createDataFrame([(c, *[sum(1 << i % BITS for i in own if i // BITS == w) for w in range(len(words))]) for c, own in of.items()],
                                 T.StructType([T.StructField(c, T.LongType()) for c in ("_cell", *words)]))
    held = marked.where(F.col(cluster).isNotNull()).select("_cell", F.col(cluster).alias("_cluster")).join(F.broadcast(bits), "_cell").groupBy("_cluster").agg(*[F.bit_or(w).alias(w) for w in words])
    places = spark.createDataFrame([(*name, i) for name, i in names.items()], T.StructType([*kinds, T.StructField("_i", T.LongType())]))
    sizes = held.select(F.explode(F.array_compact(F.array(*[x for n, w in enumerate(words) for x in _bits(w, n * BITS)]))).alias("_i")).groupBy("_i").agg(F.count("*").alias("n_clusters"))
    return wide, places.join(sizes, "_i").drop("_i")


def _bits(word: str, first: int) -> list[Column]:
    """Numbers, from ``first`` on, of the bits that are set; null for the others."""
    return [F.when(F.col(word).bitwiseAND(F.lit(1 << i)) != 0, F.lit(first + i).cast("long")) for i in range(BITS)]


def holdout_metrics(df: DataFrame, y: str, p: str, dims: Mapping[str, str], **kw: object) -> DataFrame:
    """Overall and per-dimension metrics of held-out predictions."""
    rows = slice_rows(df, y, dims, {}, None)
    return regression_metrics(rows, y, p, ["slice_type", "slice_value"], **kw)


# ---- paired effects and bootstrap ------------------------------------------------------------

def error_delta(paired: DataFrame, y: str, before: str, after: str, name: str = "error_delta") -> DataFrame:
    return paired.withColumn(name, F.abs(F.col(after) - F.col(y)) - F.abs(F.col(before) - F.col(y)))


def cluster_sums(df: DataFrame, cluster: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, cluster).agg(F.sum(value).alias("sum"), F.count(value).alias("count"), F.avg(value).alias("mean"))


def paired_effect(paired: DataFrame, y: str, before: str, after: str, cluster: str, by: Sequence[str] = ()) -> DataFrame:
    """Row-weighted and equal-cluster difference in MAE (after - before)."""
    clusters = cluster_sums(error_delta(paired, y, before, after), cluster, "error_delta", by)
    return clusters.groupBy(*by).agg(
        F.sum("count").alias("n_rows"), F.count("*").alias("n_clusters"),
        (F.sum("sum") / F.sum("count")).alias("row_weighted_delta_mae"), F.avg("mean").alias("equal_cluster_delta_mae"))


def bootstrap_draws(clusters: DataFrame, cluster: str, draws: int, seed: object, leaf: int = resample.LEAF) -> DataFrame:
    """(draw, row_weighted_delta, equal_cluster_delta): clusters resampled with replacement.

    Only cluster sums take part: each block of ``leaf`` clusters ships one row of sums a draw.
    """
    zero = F.lit(0.0)
    values = F.array(F.coalesce("sum", zero), F.col("count").cast("double"), F.coalesce("mean", zero), F.col("mean").isNotNull().cast("double"))
    placed, n, blocks = resample.place_clusters(clusters.select(cluster, values.alias("values")), cluster, seed, leaf)
    total = F.col("total")
    return resample.resampled_sums(placed, n, blocks, 4, draws, seed).select(
        "draw", F.try_divide(total[0], total[1]).alias("row_weighted_delta"), F.try_divide(total[2], total[3]).alias("equal_cluster_delta"))


def bootstrap_ci(draws: DataFrame, cols: Sequence[str], by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """(by…, column, ci_low, ci_high) from a table of draws."""
    tail = (1 - level) / 2
    q = quantile_table(draws, cols, [tail, 1 - tail], by)
    return q.select(*by, "column", F.col("n").alias("n_draws"), F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def cluster_bootstrap(clusters: DataFrame, cluster: str, draws: int, seed: object, leaf: int = resample.LEAF) -> DataFrame:
    """Point estimates with percentile intervals, one row per kind of delta."""
    table = cut_lineage(bootstrap_draws(clusters, cluster, draws, seed, leaf))  # quantiles read it twice
    point = clusters.agg((F.sum("sum") / F.sum("count")).alias("row_weighted_delta"), F.avg("mean").alias("equal_cluster_delta"))
    packed = F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).alias("estimate"))
                       for x in ("row_weighted_delta", "equal_cluster_delta")])
    return point.select(F.inline(packed)).join(bootstrap_ci(table, ["row_weighted_delta", "equal_cluster_delta"]), "column")


#: cells between the quantiles where medians of draws are expected; two more take what lies outside
MEDIAN_CELLS = 64
#: rows of one block, or of one group of blocks, that are expanded together
BLOCK_ROWS = 200_000


def _draw_medians(rows: DataFrame, cluster: str, placed: DataFrame, n: int, blocks: int, draws: int, seed: object, totals: DataFrame, first: int) -> DataFrame:
    """(draw, mdape) by the counts per cell in ``totals``; only rows of the cells that hold a draw's median are read again, for those draws alone."""
    cells = MEDIAN_CELLS + 2
    counts = totals.select("draw", F.posexplode(F.slice("total", first + 1, cells)).alias("cell", "_c"))
    w = Window.partitionBy("draw")
    counts = counts.withColumns({"_n": F.sum("_c").over(w), "_start": F.sum("_c").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")})
    low, high = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)
    def holds(rank: Column) -> Column:
        return (F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_c"))
    held = counts.where((holds(low) | holds(high)) & (F.col("_n") > 0)).select("draw", "cell", "_start", "_n")
    table = cut_lineage(held)
    by_draw: list[list[int]] = [[] for _ in range(draws)]
    for r in table.collect():  # at most two cells a draw
        by_draw[r["draw"]].append(r["cell"])
    wanted = sorted({c for own in by_draw for c in own})
    values = rows.where(F.col("cell").isin(wanted)).groupBy(cluster, "cell", "v").agg(F.count("*").alias("c"))
    joined = cut_lineage(_null_safe_join(values, placed.select(cluster, "_block", "_idx"), [cluster]))
    parts = cut_lineage(joined.groupBy("_block").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK_ROWS).alias("parts")))  # at most MOST_BLOCKS rows
    together = (parts.agg(F.sum("n")).first()[0] or 0) <= BLOCK_ROWS * resample.group_count(n, blocks)
    dealt = joined.join(F.broadcast(parts.drop("n")), "_block").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")))
    found = resample.resampled_values(dealt, n, blocks, draws, seed, by_draw, together).groupBy("draw", "cell", "v").agg(F.sum("m").alias("m")).join(table, ["draw", "cell"])
    earlier = Window.partitionBy("draw", "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = found.withColumn("_start", F.col("_start") + F.coalesce(F.sum("m").over(earlier), F.lit(0))).withColumn("_c", F.col("m"))
    return ranked.groupBy("draw").agg(((F.max(F.when(holds(low), F.col("v"))) + F.max(F.when(holds(high), F.col("v")))) / 2).alias("mdape"))


def bootstrap_metrics(df: DataFrame, y: str, p: str, cluster: str, draws: int, seed: object, eps: float = EPS, leaf: int = resample.LEAF) -> DataFrame:
    """M1 rebuilt per draw: means from weighted cluster sums, mdape from weighted cluster histograms.

    Every cluster carries its sums and how many of its values lie in each of ``MEDIAN_CELLS`` cells around the median, and one resampling adds up both.  That tells the cell of
    each draw's median; its rows alone are weighted one by one.  A median outside the expected cells only costs more.
    """
    r = residual(y, p)
    # deviations from the grand mean keep the rebuilt total sum of squares accurate
    rows = df.select(cluster, F.col(y).cast("double").alias("_y"), r.alias("_r"), _smape(y, p, eps).alias("_s"), absolute_percentage_error(y, p, eps).alias("v"))
    n_clusters = df.select(cluster).distinct().count()
    reach = min(0.5, 3 / max(1, n_clusters) ** 0.5)
    probs = [0.5 + reach * (2 * i / MEDIAN_CELLS - 1) for i in range(MEDIAN_CELLS + 1)]
    edges = quantile_table(rows, ["v"], probs).select("q").scalar()
    centred = rows.withColumns({"_centre": df.agg(F.avg(y)).scalar(), "_edges": edges}).withColumn("_y", F.col("_y") - F.col("_centre"))
    cell = sum([F.when(F.col("v") > F.col("_edges")[i], 1).otherwise(0) for i in range(len(probs))], F.lit(0))
    placed_rows = cut_lineage(centred.withColumn("cell", F.when(F.col("v").isNotNull(), cell)).drop("_edges", "_centre"))
    sums = {"n": F.count("*"), "a": F.sum(F.abs("_r")), "s": F.sum(F.col("_r") * F.col("_r")), "b": F.sum("_r"), "c": F.count("_r"),
            "sm": F.sum("_s"), "y1": F.sum("_y"), "y2": F.sum(F.col("_y") * F.col("_y")), "yc": F.count("_y")}
    counted = [*sums.values(), *[F.count_if(F.col("cell") == i) for i in range(MEDIAN_CELLS + 2)]]
    clusters = placed_rows.groupBy(cluster).agg(F.array(*[F.coalesce(x.cast("double"), F.lit(0.0)) for x in counted]).alias("values"))
    placed, n, blocks = resample.place_clusters(clusters, cluster, seed, leaf)
    totals = cut_lineage(resample.resampled_sums(placed, n, blocks, len(counted), draws, seed))
    t = {k: F.col("total")[i] for i, k in enumerate(sums)}
    sst = t["y2"] - F.try_divide(t["y1"] * t["y1"], t["yc"])
    means = totals.select(
        "draw", t["n"].cast("bigint").alias("n_rows"), F.try_divide(t["a"], t["c"]).alias("mae"), F.sqrt(F.try_divide(t["s"], t["c"])).alias("rmse"),
        F.when(sst > 0, 1 - F.try_divide(t["s"], sst)).alias("r2"), F.try_divide(t["sm"], t["c"]).alias("smape"), F.try_divide(t["b"], t["c"]).alias("signed_bias"))
    medians = _draw_medians(placed_rows.where(F.col("cell").isNotNull()).select(cluster, "cell", "v"), cluster, placed, n, blocks, draws, seed, totals, len(sums))
    return means.join(medians, "draw", "left")


# ---- validity, cells, choices ----------------------------------------------------------------

def prediction_validity(df: DataFrame, p: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Non-finite, negative and zero predictions, fractions, extremes and distinct runs."""
    v = F.col(p)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    out = df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.count_if(bad).alias("n_nonfinite"), F.count_if(~bad & (v < 0)).alias("n_negative"),
        F.count_if(~bad & (v == 0)).alias("n_zero"), F.min(F.when(~bad, v)).alias("min_prediction"),
        F.max(F.when(~bad, v)).alias("max_prediction"), F.countDistinct(key).alias("n_unique_runs"))
    return out.withColumn("negative_fraction", F.try_divide(F.col("n_negative"), F.col("n_rows")))


def summarise_cells(df: DataFrame, y: str, p: str, by: Sequence[str], **kw: object) -> DataFrame:
    """Metrics per experiment cell, best first (mae, rmse, then names)."""
    return regression_metrics(df, y, p, by, **kw).orderBy("mae", "rmse", *by)


def tail_metrics(df: DataFrame, y: str, p: str, by: Sequence[str], upper: float = 0.75, top: float = 0.90, **kw: object) -> DataFrame:
    """Cell metrics with tail columns; thresholds are quantiles of the whole prediction table."""
    q = quantile_table(df, [y], [upper, top], **kw).select("q").scalar()
    rows = df.withColumns({"_u": F.col(y) >= q.getItem(0), "_t": F.col(y) >= q.getItem(1)})
    r = residual(y, p)
    tails = rows.groupBy(*by).agg(
        F.avg(F.when(F.col("_u"), F.abs(r))).alias("upper_mae"), F.avg(F.when(F.col("_u"), r)).alias("upper_signed_bias"),
        F.avg(F.when(F.col("_t"), F.abs(r))).alias("top_mae"), F.avg(F.when(F.col("_t"), r)).alias("top_signed_bias"),
        F.avg(F.when(~F.col("_u"), F.abs(r))).alias("lower_mae"))
    return _null_safe_join(regression_metrics(df, y, p, by, **kw), tails, by)


def select_candidate(errors: DataFrame, by: Sequence[str], candidate: str = "candidate", error: str = "abs_error_sum",
                     rows: str = "n_rows", failed: str | None = None) -> DataFrame:
    """Row-weighted validation MAE per candidate; lowest score wins, then the lowest index; failed ones lose."""
    score = F.sum(error) / F.sum(rows)
    if failed:
        score = F.when(F.max(failed), F.lit(float("inf"))).otherwise(score)
    scored = errors.groupBy(*by, candidate).agg(score.alias("score"))
    return first_per_group(scored, by, ["score", candidate]) if by else scored.orderBy("score", candidate).limit(1)


def top_candidates(cells: DataFrame, n: int = 2, exclude: Column | None = None, names: Sequence[str] = ()) -> DataFrame:
    """Shortlist: best n by mae, rmse and names, without baselines."""
    return (cells.where(~exclude) if exclude is not None else cells).orderBy("mae", "rmse", *names).limit(n)


def choose_final(cells: DataFrame, names: Sequence[str], mae_slack: float = 1.05, tail_gain: float = 0.95,
                 bias_gain: float = 0.80) -> DataFrame:
    """Best MAE, unless a cell within 5 % of it cuts tail MAE by 5 % and tail bias by 20 %."""
    best = cells.orderBy("mae", "rmse", *names).limit(1).select(F.struct("mae", "upper_mae", "upper_signed_bias")).scalar()
    marked = cells.withColumn("_b", best)
    qualified = ((F.col("mae") <= mae_slack * F.col("_b.mae")) & (F.col("upper_mae") <= tail_gain * F.col("_b.upper_mae"))
                 & (F.abs("upper_signed_bias") <= bias_gain * F.abs(F.col("_b.upper_signed_bias"))))
    order = marked.withColumn("qualified", F.coalesce(qualified, F.lit(False)))
    # qualified cells come first, ranked by tail MAE; the rest by overall MAE
    return order.orderBy(F.col("qualified").desc(), F.when(F.col("qualified"), F.col("upper_mae")), "mae",
                         F.when(~F.col("qualified"), F.col("rmse")), *names).limit(1).drop("_b")


def choose_level(matrix: DataFrame, level: str, order: Sequence[str], role: str | None = None, main: str = "main") -> DataFrame:
    """Winner per level among rows of the main role, with a full tie-break order."""
    rows = matrix.where(F.col(role) == main) if role else matrix
    return first_per_group(rows, [level], list(order))


def effect_tally(effects: DataFrame, delta: str, low: str, high: str, by: Sequence[str] = ()) -> DataFrame:
    """Range of deltas and how many intervals lie wholly below or above zero."""
    return effects.groupBy(*by).agg(
        F.count("*").alias("n_effects"), F.min(delta).alias("min_delta"), F.max(delta).alias("max_delta"),
        F.count_if(F.col(high) < 0).alias("n_improved"), F.count_if(F.col(low) > 0).alias("n_worsened"))


# ---- association -----------------------------------------------------------------------------

def corr_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson", **kw: object) -> DataFrame:
    """(x, y, r) for all pairs; Spearman is Pearson on average ranks from value histograms."""
    if method == "spearman":
        ranked = df.select(*cols)
        for i, x in enumerate(cols):
            ranks = value_ranks(df, x, **kw).select(x, F.col("avg_rank").alias(f"_r{i}"))
            ranked = join_many_to_one(ranked, ranks, x)
        df, source = ranked, [f"_r{i}" for i in range(len(cols))]
    else:
        source = list(cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(len(cols))]
    wide = df.agg(*[F.corr(source[i], source[j]).alias(f"_c{i}_{j}") for i, j in pairs if i < j])
    packed = F.array(*[F.struct(F.lit(cols[i]).alias("x"), F.lit(cols[j]).alias("y"),
                                (F.lit(1.0) if i == j else F.col(f"_c{min(i, j)}_{max(i, j)}")).alias("r")) for i, j in pairs])
    return wide.select(F.inline(packed))


def association(df: DataFrame, x: str, y: str, **kw: object) -> DataFrame:
    """Pearson r, Spearman rho, n and t = r*sqrt((n-2)/(1-r²)) over finite pairs; null if n < 3 or constant."""
    from plumbline.functions.numeric import finite
    pairs = df.select(finite(F.col(x)).alias("x"), finite(F.col(y)).alias("y")).dropna()
    rx = value_ranks(pairs, "x", **kw).select("x", F.col("avg_rank").alias("_rx"))
    ry = value_ranks(pairs, "y", **kw).select("y", F.col("avg_rank").alias("_ry"))
    joined = join_many_to_one(join_many_to_one(pairs, rx, "x"), ry, "y")
    usable = (F.count("*") >= 3) & (F.var_pop("x") > 0) & (F.var_pop("y") > 0)
    out = joined.agg(F.count("*").alias("n"), F.when(usable, F.corr("x", "y")).alias("pearson"),
                     F.when(usable, F.corr("_rx", "_ry")).alias("spearman"))
    def t(r: str) -> Column:
        return F.try_divide(F.col(r) * F.sqrt(F.col("n") - 2), F.sqrt(1 - F.col(r) * F.col(r)))
    return out.withColumns({"pearson_t": t("pearson"), "spearman_t": t("spearman")})


