"""Profiling: nulls, duplicates, keys, coverage, distributions, identities, lengths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.numeric import finite, relative_error
from plumbline.operators.joins import join_many_to_one, unique_guard
from plumbline.operators.ordering import agg_with_medians, quantile_columns, quantile_table


def _string_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _unpivot(row: DataFrame, entries: Sequence[tuple[str, Mapping[str, Column]]], keep: Sequence[str] = ()) -> DataFrame:
    """One wide aggregate row (per group) -> one row per profiled column."""
    packed = F.array(*[F.struct(F.lit(name).alias("column"), *[v.alias(k) for k, v in values.items()])
                       for name, values in entries])
    return row.select(*keep, F.inline(packed))


# ---- nulls, blanks, duplicates, keys ---------------------------------------------------------

def _present(df: DataFrame, name: str) -> Column:
    """The column with NaN as null: missing has one meaning."""
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return F.when(~F.isnan(name), F.col(name)) if floating else F.col(name)


def null_profile(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by…, column, null_count, null_rate, n_rows) from one aggregate over one scan."""
    cols = [x for x in (cols or df.columns) if x not in by]
    wide = df.groupBy(*by).agg(F.count("*").alias("_n"), *[F.count(_present(df, x)).alias(f"_c{i}") for i, x in enumerate(cols)])
    missing = [F.col("_n") - F.col(f"_c{i}") for i in range(len(cols))]
    return _unpivot(wide, [(x, {"null_count": m, "null_rate": F.coalesce(F.try_divide(m, F.col("_n")), F.lit(0.0)),
                                "n_rows": F.col("_n")}) for x, m in zip(cols, missing)], by)


def missingness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, available, missing, coverage)."""
    p = null_profile(df, cols)
    return p.select("column", (F.col("n_rows") - F.col("null_count")).alias("available"),
                    F.col("null_count").alias("missing"), (1 - F.col("null_rate")).alias("coverage"))


def blank_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """String columns: values that are empty after trimming."""
    cols = list(cols or _string_cols(df))
    wide = df.agg(*[F.count_if(F.trim(x) == "").alias(f"_b{i}") for i, x in enumerate(cols)])
    return _unpivot(wide, [(x, {"blank_count": F.col(f"_b{i}")}) for i, x in enumerate(cols)])


def row_hash(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    """128 bits of a row, nulls told apart from absent text and both zeros alike."""
    floating = (T.DoubleType, T.FloatType)
    parts = [x for c in cols for x in (F.col(c) + F.lit(0.0) if isinstance(df.schema[c].dataType, floating) else F.col(c), F.col(c).isNull())]
    return [F.xxhash64(*parts).alias("_h1"), F.xxhash64(F.lit(1), *parts).alias("_h2")]


def exact_duplicates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Groups of identical rows (nulls equal) and rows in them; what is shuffled are hashes, not rows, and copies combine map-side."""
    groups = df.groupBy(*row_hash(df, cols or df.columns)).agg(F.count("*").alias("_n"))
    return groups.agg(F.count("*").alias("distinct_rows"), F.count_if(F.expr("_n > 1")).alias("duplicate_groups"),
                      F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("rows_in_duplicate_groups"))


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def key_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unique keys, duplicate groups and rows in them."""
    return key_counts(df, keys).agg(
        F.count("*").alias("unique_keys"), F.count_if(F.expr("n > 1")).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_duplicate_groups"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_multiplicity"))


def key_multiplicity(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Histogram: how many keys occur n times."""
    return key_counts(df, keys).groupBy(F.col("n").alias("multiplicity")).agg(F.count("*").alias("n_keys"))


def duplicate_examples(df: DataFrame, keys: Sequence[str], n_examples: int = 20) -> DataFrame:
    """First examples, in key order, of keys that occur more than once (a bounded report)."""
    return key_counts(df, keys).where("n > 1").orderBy(*keys).limit(n_examples)


def duplicated(df: DataFrame, keys: Sequence[str], name: str = "is_duplicated") -> DataFrame:
    """Flag rows whose key occurs more than once.

    Counts are aggregated first and joined back, so a hot key never becomes one
    window partition.
    """
    repeated = key_counts(df, keys).where("n > 1").select(*keys, F.lit(True).alias(name))
    return join_many_to_one(df, repeated, keys, null_safe=True).withColumn(name, F.coalesce(F.col(name), F.lit(False)))


# ---- coverage --------------------------------------------------------------------------------

def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n) for several columns in one pass; null is a value."""
    packed = F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).cast("string").alias("value")) for x in cols])
    return df.select(F.inline(packed)).groupBy("column", "value").agg(F.count("*").alias("n"))


def cross_tab(df: DataFrame, row: str, col: str) -> DataFrame:
    return df.groupBy(row, col).agg(F.count("*").alias("n"))


def cross_pivot(df: DataFrame, row: str, col: str, values: Sequence[object]) -> DataFrame:
    """Counts with one column per given value, zero where a cell is empty."""
    return df.groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(str(v)) for v in values])


def group_size_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups, and min / median / max of their sizes (median over the size histogram)."""
    hist = key_multiplicity(df, keys)
    ends = hist.agg(F.sum("n_keys").alias("n_groups"), F.min("multiplicity").alias("min_size"),
                    F.max("multiplicity").alias("max_size"))
    median = quantile_table(hist, ["multiplicity"], [0.5], weight="n_keys").select(F.col("q")[0]).scalar()
    return ends.withColumn("median_size", median)


def members(df: DataFrame, group: str, member: str) -> DataFrame:
    """Distinct (group, member) rows; a set kept as rows has no size limit."""
    return df.select(group, member).distinct()


def member_counts(df: DataFrame, group: str, member: str) -> DataFrame:
    return df.groupBy(group).agg(F.countDistinct(member).alias("n_members"))


def confounded(df: DataFrame, group: str, task: str) -> DataFrame:
    """Groups seen in exactly one task."""
    return df.groupBy(group).agg(F.countDistinct(task).alias("n_tasks"), F.count("*").alias("n_rows")).withColumn(
        "confounded", F.col("n_tasks") == 1)


def group_coverage(df: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.countDistinct(ident).alias("n_ids"))


def status_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def flag_by(df: DataFrame, flag: str, group: str | None = None) -> DataFrame:
    """True / false / null counts and the true rate; null lands in neither bucket."""
    value = F.col(flag)
    out = (df.groupBy(group) if group else df.groupBy()).agg(
        F.count("*").alias("n_rows"), F.count_if(value).alias("n_true"), F.count_if(~value).alias("n_false"),
        F.count_if(value.isNull()).alias("n_unknown"))
    return out.withColumn("rate_true", F.try_divide(F.col("n_true"), F.col("n_rows")))


def reason_counts(df: DataFrame, reason: str, flag: str) -> DataFrame:
    """Text before the first ':' ('none' when empty), only where the flag is false."""
    head = F.trim(F.substring_index(F.coalesce(F.col(reason), F.lit("")), ":", 1))
    category = F.coalesce(F.nullif(head, F.lit("")), F.lit("none"))
    return df.where(~F.col(flag)).groupBy(category.alias("category")).agg(F.count("*").alias("n"))


def predicate_counts(df: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """(predicate, n_true, n_checked) for named conditions in one aggregate."""
    wide = df.agg(*[x for i, p in enumerate(predicates.values())
                    for x in (F.count_if(p).alias(f"_t{i}"), F.count(p).alias(f"_c{i}"))])
    packed = F.array(*[F.struct(F.lit(n).alias("predicate"), F.col(f"_t{i}").alias("n_true"),
                                F.col(f"_c{i}").alias("n_checked")) for i, n in enumerate(predicates)])
    return wide.select(F.inline(packed))


def cell_coverage(df: DataFrame, dims: Sequence[str], flag: str | None = None) -> DataFrame:
    """Observed cells, cells with a true flag, and the naive cartesian count."""
    cells = df.groupBy(*dims).agg((F.max(F.col(flag)) if flag else F.lit(True)).alias("_f"))
    distinct = cells.agg(F.count("*").alias("observed_cells"), F.count_if("_f").alias("flagged_cells"),
                         *[F.countDistinct(d).alias(f"_d{i}") for i, d in enumerate(dims)])
    product = F.lit(1).cast("bigint")
    for i in range(len(dims)):
        product = product * F.col(f"_d{i}")
    return distinct.select("observed_cells", "flagged_cells", product.alias("cartesian_cells"))


def coverage(df: DataFrame, dims: Sequence[str], flags: Sequence[str], population: str | None = None) -> DataFrame:
    """(population, dimension, value, n, flag counts and rates) with grouping sets in one pass; nulls are called null, and a text of that name is quoted.

    With ``population`` (a boolean column) the same slices are given for all rows
    and for the flagged rows, counted side by side rather than by a second scan.
    """
    counts = [F.count("*").alias("n_all"), *[F.count_if(F.col(f)).alias(f"all_{f}") for f in flags]]
    if population:
        inside = F.col(population)
        counts += [F.count_if(inside).alias("n_pop"), *[F.count_if(inside & F.col(f)).alias(f"pop_{f}") for f in flags]]
    text = df.select(*[F.col(d).cast("string").alias(d) for d in dims], *dict.fromkeys([*flags, *([population] if population else [])]))
    cells = text.groupingSets([[], *[[d] for d in dims]], *dims).agg(F.grouping_id().alias("_gid"), *counts)
    # grouping_id has a 1 bit for every column that is not grouped
    full = (1 << len(dims)) - 1
    dimension, value = F.lit("overall"), F.lit("all")
    for i, d in enumerate(dims):
        mine = F.col("_gid") == (full ^ (1 << (len(dims) - 1 - i)))
        dimension = F.when(mine, d).otherwise(dimension)
        spelled = F.when(F.col(d).rlike('^"*null"*$'), F.concat(F.lit('"'), F.col(d), F.lit('"'))).otherwise(F.col(d))
        value = F.when(mine, F.coalesce(spelled, F.lit("null"))).otherwise(value)
    blocks = [("all", "n_all", "all_")] + ([(population, "n_pop", "pop_")] if population else [])
    packed = F.array(*[F.struct(
        F.lit(name).alias("population"), F.col(n).alias("n"),
        *[F.col(prefix + f).alias(f"n_{f}") for f in flags],
        *[F.coalesce(F.try_divide(F.col(prefix + f), F.col(n)), F.lit(0.0)).alias(f"rate_{f}") for f in flags])
        for name, n, prefix in blocks])
    out = cells.select(dimension.alias("dimension"), value.alias("value"), F.inline(packed))
    return out.where("n > 0").select("population", "dimension", "value", "n", *[x for f in flags for x in (f"n_{f}", f"rate_{f}")])


def presence_by(df: DataFrame, dims: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Present count and coverage of each column per (dimension, value)."""
    flagged = df.select(*dims, *[F.col(x).isNotNull().alias(x) for x in cols])
    return coverage(flagged, dims, cols).drop("population")


def container_patterns(df: DataFrame, maps: Sequence[str]) -> DataFrame:
    """Counts of the sorted key pattern ('0|1|2') of map columns; 'missing' where null."""
    packed = F.array(*[F.struct(F.lit(m).alias("column"), F.coalesce(
        F.array_join(F.array_sort(F.map_keys(F.col(m))), "|"), F.lit("missing")).alias("pattern")) for m in maps])
    return df.select(F.inline(packed)).groupBy("column", "pattern").agg(F.count("*").alias("n"))


def composition(df: DataFrame, group: str, col: str) -> DataFrame:
    """(group, value, n): composition as rows, no limit on distinct values."""
    return df.groupBy(group, F.col(col).cast("string").alias("value")).agg(F.count("*").alias("n"))


def composition_json(df: DataFrame, group: str, col: str) -> DataFrame:
    """Value -> count as one JSON text per group, for category columns; rows are counted before they are collected.

    Nulls are counted in the column ``missing``, apart from a value spelled 'null'.
    """
    counts = composition(df, group, col)
    entry = F.struct(F.col("value").alias("key"), F.col("n").alias("value"))
    known = F.collect_list(F.when(F.col("value").isNotNull(), entry))
    return counts.groupBy(group).agg(
        F.to_json(F.map_from_entries(F.array_sort(known))).alias("composition"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"))


# ---- numeric profiles ------------------------------------------------------------------------

PROFILE_PROBS = {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0}


def numeric_profile(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), iqr_factor: float = 1.5,
                    **kw: object) -> DataFrame:
    """count, minimum, q1, median, q3, maximum, non-positive and IQR outliers per column."""
    return _outlier_profile(df, cols, by, PROFILE_PROBS, iqr_factor, False, **kw)


def iqr_outliers(df: DataFrame, cols: Sequence[str], k: float = 1.5, by: Sequence[str] = (), high_only: bool = False,
                 **kw: object) -> DataFrame:
    """count, non-positive and values strictly outside q1 - k*iqr .. q3 + k*iqr (or only above)."""
    out = _outlier_profile(df, cols, by, {"q1": 0.25, "q3": 0.75}, k, high_only, **kw)
    return out.drop("q1", "q3")


def _outlier_profile(df: DataFrame, cols: Sequence[str], by: Sequence[str], probs: Mapping[str, float], k: float,
                     high_only: bool, **kw: object) -> DataFrame:
    """Quantiles once, then one pass that counts against the limits they give."""
    table = quantile_columns(df, cols, dict(probs), by, **kw).drop("n")

    def outside(v: Column, q1: Column, q3: Column) -> Column:
        high = v > q3 + k * (q3 - q1)
        return high if high_only else high | (v < q1 - k * (q3 - q1))
    if not by:
        # one entry per profiled column
        lookup = table.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct(*probs)))).alias("m")).scalar()
        aggs, entries = [F.any_value("_limits").alias("_limits")], []
        for i, x in enumerate(cols):
            v, q = F.col(x).cast("double"), F.element_at("_limits", F.lit(x))
            aggs += [F.count(v).alias(f"_c{i}"), F.count_if(v <= 0).alias(f"_z{i}"),
                     F.count_if(outside(v, q["q1"], q["q3"])).alias(f"_o{i}")]
            entries.append((x, {**{p: q[p] for p in probs}, "count": F.col(f"_c{i}"), "non_positive": F.col(f"_z{i}"),
                                "outliers": F.col(f"_o{i}")}))
        return _unpivot(df.select(*cols, lookup.alias("_limits")).agg(*aggs), entries)
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("_g")  # null-safe join key
    packed = F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).cast("double").alias("v")) for x in cols])
    joined = join_many_to_one(df.select(group, F.inline(packed)), table.select(group, *by, "column", *probs), ["_g", "column"], "inner")
    v = F.col("v")
    return joined.groupBy(*by, "column", *probs).agg(
        F.count(v).alias("count"), F.count_if(v <= 0).alias("non_positive"),
        F.count_if(outside(v, F.col("q1"), F.col("q3"))).alias("outliers"))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    l, r = left.alias("l"), right.alias("r")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return l.join(r, cond, how).select("l.*", *[F.col(f"r.{x}").alias(x) for x in right.columns if x not in keys])


def distribution(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), **kw: object) -> DataFrame:
    """n, nunique, min, p5, p25, median, p75, p95, max, mean, population std, cv, p95/p5 and log10 range."""
    packed = F.array(*[F.struct(F.lit(x).alias("column"), finite(F.col(x)).alias("v")) for x in cols])
    long = df.select(*by, F.inline(packed))
    v = F.col("v")
    # a histogram per value first: distinct counts and moments then need one more small step
    hist = long.where(v.isNotNull()).groupBy(*by, "column", "v").agg(F.count("*").alias("_c"))
    mean = F.try_divide(F.sum(v * F.col("_c")), F.sum("_c"))
    moments = hist.groupBy(*by, "column").agg(
        F.sum("_c").alias("n"), F.count("*").alias("nunique"), F.min("v").alias("minimum"), F.max("v").alias("maximum"),
        mean.alias("mean"), F.min(F.when(v > 0, v)).alias("_pmin"), F.max(F.when(v > 0, v)).alias("_pmax"))
    spread = long.groupBy(*by, "column").agg(F.stddev_pop("v").alias("std"))
    q = quantile_table(df.select(*by, *[finite(F.col(x)).alias(x) for x in cols]), cols,
                       [0.05, 0.25, 0.5, 0.75, 0.95], by, **kw)
    q = q.select(*by, "column", *[F.col("q")[i].alias(n) for i, n in enumerate(["p5", "p25", "median", "p75", "p95"])])
    out = _null_safe_join(_null_safe_join(moments, spread, [*by, "column"]), q, [*by, "column"])
    return out.withColumns({
        "cv": F.try_divide(F.col("std"), F.abs(F.col("mean"))),
        "p95_to_p5": F.when(F.col("p5") > 0, F.col("p95") / F.col("p5")),
        "log10_range": F.log10("_pmax") - F.log10("_pmin"),
    }).drop("_pmin", "_pmax")


# ---- identities ------------------------------------------------------------------------------

def identity_errors(df: DataFrame, observed: Column, expected: Column, keep: Sequence[str]) -> DataFrame:
    """Rows where both sides exist, with their relative error."""
    error = relative_error(observed.cast("double"), expected.cast("double"))
    return df.select(*keep, error.alias("relative_error")).where(F.col("relative_error").isNotNull())


def identity_check(df: DataFrame, observed: Column, expected: Column, tol: float = 1e-9, **kw: object) -> DataFrame:
    """checked, failed (strictly above tol), max and median relative error; null rows are skipped.

    For a ratio identity pass ``try_divide``: a zero denominator is skipped too.
    """
    errors = identity_errors(df, observed, expected, [])
    e = F.col("relative_error")
    metrics = {"checked": F.count("*"), "failed": F.count_if(e > tol), "max_relative_error": F.max(e)}
    return agg_with_medians(errors, metrics, [], {"median_relative_error": e}, **kw)


def identity_failures(df: DataFrame, observed: Column, expected: Column, keys: Sequence[str], tol: float = 1e-9,
                      n: int = 50) -> DataFrame:
    """First failing rows in key order (a bounded report)."""
    return identity_errors(df, observed, expected, keys).where(F.col("relative_error") > tol).orderBy(*keys).limit(n)


def order_check(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows whose columns are non-decreasing (ties allowed); rows with a null are skipped."""
    present = F.lit(True)
    rising = F.lit(True)
    for x in cols:
        present = present & F.col(x).isNotNull()
    for a, b in zip(cols, cols[1:]):
        rising = rising & (F.col(a) <= F.col(b))
    return df.agg(F.count_if(present).alias("checked"), F.count_if(present & ~rising).alias("failed"))


def utilisation(df: DataFrame, num: str, den: str, floor: float = 0.85, by: Sequence[str] = (), **kw: object) -> DataFrame:
    """num / den where den is not zero: rows, min, median, max and rows below the floor."""
    ratio = df.select(*by, F.try_divide(F.col(num).cast("double"), F.col(den).cast("double")).alias("ratio"))
    ratio = ratio.where(F.col("ratio").isNotNull())
    r = F.col("ratio")
    metrics = {"n": F.count("*"), "minimum": F.min(r), "maximum": F.max(r), "below_floor": F.count_if(r < floor)}
    return agg_with_medians(ratio, metrics, by, {"median": r}, **kw)


# ---- field values, expectations, lengths, differences ----------------------------------------

def summarise_values(long: DataFrame, path: str = "path", value: str = "value", top: int = 5) -> DataFrame:
    """Per path: present, unique, and its most common values as rows ranked 1..top.

    Values are counted first; ``row_number() <= top`` lets Spark drop rows before the shuffle.
    """
    counts = long.groupBy(path, value).agg(F.count("*").alias("n"))
    totals = counts.groupBy(path).agg(F.sum("n").alias("present"), F.count("*").alias("unique"))
    w = Window.partitionBy(path).orderBy(F.col("n").desc(), F.col(value).asc_nulls_last())
    best = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return join_many_to_one(best, totals, path, null_safe=True)


def availability(long: DataFrame, path: str, group: str, ident: str) -> DataFrame:
    """In how many documents of each group a path occurs."""
    return long.groupBy(path, group).agg(F.countDistinct(ident).alias("n_documents"))


def check_expected(long: DataFrame, spec: DataFrame, group: str, path: str = "path", value: str = "value") -> DataFrame:
    """Checked and mismatching values per (group, path) against expected ones; absent fields are not checked."""
    joined = join_many_to_one(long, unique_guard(spec, [group, path], "expected values"), [group, path], "inner")
    return joined.groupBy(group, path).agg(
        F.count("*").alias("checked"), F.count_if(~F.col(value).eqNullSafe(F.col("expected"))).alias("mismatches"))


def length_stats(df: DataFrame, length: str, by: Sequence[str] = (), repeats: int | str = 1, **kw: object) -> DataFrame:
    """Count, sum and sum of squares times repeats; mean, p50, p90, p95, min, max and std unscaled.

    ``repeats`` is a number or a column constant inside each group.  A length that
    is null or not positive fails the query.
    """
    bad = F.raise_error(F.lit("positive lengths and repeats are required"))
    rep = F.lit(repeats) if isinstance(repeats, int) else F.max(repeats)
    value = F.when(F.col(length) > 0, F.col(length).cast("bigint")).otherwise(bad)
    checked = df.withColumn(length, value)
    sums = checked.groupBy(*by).agg(
        F.count("*").alias("_n"), F.sum(length).alias("_s"), F.sum(F.col(length) * F.col(length)).alias("_s2"),
        rep.cast("bigint").alias("_r"), F.avg(length).alias("mean"), F.min(length).alias("min"),
        F.max(length).alias("max"), F.stddev_pop(length).alias("std"))
    scaled = sums.select(
        *by, (F.col("_n") * F.col("_r")).alias("total_count"), (F.col("_s") * F.col("_r")).alias("total_length"),
        (F.col("_s2") * F.col("_r")).alias("total_length_sq"), "mean", "min", "max", "std")
    q = quantile_columns(checked, [length], {"p50": 0.5, "p90": 0.9, "p95": 0.95}, by, **kw).drop("column", "n")
    if by:
        return _null_safe_join(scaled, q, by)
    row = q.select(F.struct("p50", "p90", "p95")).scalar()
    return scaled.withColumns({k: row.getField(k) for k in ("p50", "p90", "p95")})


def second_moments(df: DataFrame, length: str, by: Sequence[str] = ()) -> DataFrame:
    """Second moment, root mean square and coefficient of variation of a length column."""
    v = F.col(length).cast("double")
    out = df.groupBy(*by).agg(F.avg(v * v).alias("second_moment"), F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"))
    return out.select(*by, "second_moment", F.sqrt("second_moment").alias("rms"), F.try_divide(F.col("_s"), F.col("_m")).alias("cv"))


def delta_report(df: DataFrame, a: str, b: str, **kw: object) -> DataFrame:
    """Differences b - a: rows, zero / positive counts, min, median, max."""
    diff = df.select((F.col(b) - F.col(a)).cast("double").alias("delta")).where(F.col("delta").isNotNull())
    q = quantile_columns(diff, ["delta"], {"min_delta": 0.0, "median_delta": 0.5, "max_delta": 1.0}, **kw)
    counts = diff.agg(F.struct(F.count_if(F.col("delta") == 0).alias("z"), F.count_if(F.col("delta") > 0).alias("p"))).scalar()
    return q.select(F.col("n").alias("n_rows"), counts.getField("z").alias("zero_delta"),
                    counts.getField("p").alias("positive_delta"), "min_delta", "median_delta", "max_delta")


def delta_by_pair(df: DataFrame, a: str, b: str, pair: Sequence[str]) -> DataFrame:
    """Mean difference and mean ratio per distinct pair."""
    return df.groupBy(*pair).agg(F.avg(F.col(b) - F.col(a)).alias("mean_delta"),
                                 F.avg(F.try_divide(F.col(b).cast("double"), F.col(a).cast("double"))).alias("mean_ratio"))


def feature_coverage(df: DataFrame, levels: Mapping[str, Sequence[str]], group: str,
                     structural_na: Mapping[str, Column] | None = None) -> DataFrame:
    """Per (level, feature): rows, groups, missing, unique, structural-NA and unknown counts."""
    structural_na = structural_na or {}
    features = list(dict.fromkeys(f for fs in levels.values() for f in fs))
    packed = F.array(*[F.struct(
        F.lit(f).alias("feature"), F.col(f).cast("string").alias("v"),
        F.coalesce(structural_na.get(f, F.lit(False)), F.lit(False)).alias("na")) for f in features])
    long = df.select(group, F.inline(packed))
    # one row per (feature, value, group) first: both distinct counts then come from small rows
    cells = long.groupBy("feature", "v", group).agg(F.count("*").alias("_n"), F.count_if("na").alias("_na"),
                                                    F.count_if(F.col("v").isNull() & ~F.col("na")).alias("_unk"))
    stats = cells.groupBy("feature").agg(
        F.sum("_n").alias("n_rows"), F.countDistinct(group).alias("n_groups"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("_n"))), F.lit(0)).alias("n_missing"),
        F.countDistinct("v").alias("n_unique"), F.sum("_na").alias("n_structural_na"), F.sum("_unk").alias("n_unknown"))
    plan = F.array(*[F.struct(F.lit(l).alias("level"), F.lit(f).alias("f")) for l, fs in levels.items() for f in fs])
    return stats.select("*", F.explode(F.filter(plan, lambda x: x["f"] == F.col("feature"))).alias("_p")).select(
        F.col("_p.level").alias("level"), "feature", "n_rows", "n_groups", "n_missing", "n_unique", "n_structural_na", "n_unknown")


def repeat_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, sample std and max over repeats."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                               F.stddev_samp(value).alias("std"), F.max(value).alias("max"))


# ---- schema-level ----------------------------------------------------------------------------

def classify_fields(df: DataFrame, exact: Mapping[str, tuple[str, bool]], prefixes: Mapping[str, tuple[str, bool]] | None = None,
                    fragments: Mapping[str, tuple[str, bool]] | None = None) -> DataFrame:
    """(column, role, allowed, non_null): exact name, then prefix, then fragment; default unclassified."""
    def role_of(name: str) -> tuple[str, bool]:
        if name in exact:
            return exact[name]
        for p, r in (prefixes or {}).items():
            if name.startswith(p):
                return r
        for f, r in (fragments or {}).items():
            if f in name:
                return r
        return ("unclassified", False)
    roles = {x: role_of(x) for x in df.columns}
    wide = df.agg(*[F.count(x).alias(f"_c{i}") for i, x in enumerate(df.columns)])
    return _unpivot(wide, [(x, {"role": F.lit(roles[x][0]), "allowed": F.lit(roles[x][1]), "non_null": F.col(f"_c{i}")})
                           for i, x in enumerate(df.columns)])


def role_manifest(df: DataFrame, contract: Mapping[str, str], x_prefix: str = "x_",
                  allowed_roles: Sequence[str] = ()) -> DataFrame:
    """(column, role, allowed, dtype, non_null); an x column the contract does not know raises."""
    unknown = [x for x in df.columns if x.startswith(x_prefix) and x not in contract]
    if unknown:
        raise ValueError(f"columns missing from the role contract: {unknown}")
    wide = df.agg(*[F.count(x).alias(f"_c{i}") for i, x in enumerate(df.columns)])
    entries = []
    for i, f in enumerate(df.schema.fields):
        role = contract.get(f.name, "diagnostic")
        entries.append((f.name, {"role": F.lit(role), "allowed": F.lit(role in allowed_roles),
                                 "dtype": F.lit(f.dataType.simpleString()), "non_null": F.col(f"_c{i}")}))
    return _unpivot(wide, entries)


def candidate_keys(df: DataFrame, key_sets: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """Each named key restricted to the columns that exist."""
    return {name: [x for x in cols if x in df.columns] for name, cols in key_sets.items()}

