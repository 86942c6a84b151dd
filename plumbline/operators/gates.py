"""Contract checks.  Each returns rows (name, status, observed, expected); ``run_checks`` unites and enforces them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.keys import table_digest
from plumbline.functions.numeric import finite, relative_error
from plumbline.operators.evaluation import bootstrap_ci, regression_metrics
from plumbline.operators.joins import join_many_to_one
from plumbline.operators.profile import _null_safe_join
from plumbline.operators.sets import support


def _text(value: object) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("string")


def checks(row: DataFrame, entries: Mapping[str, tuple[Column, Column, object]]) -> DataFrame:
    """One aggregate row -> check rows; an entry is (passes, observed, expected)."""
    packed = F.array(*[F.struct(
        F.lit(name).alias("name"), F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail").alias("status"),
        _text(observed).alias("observed"), _text(expected).alias("expected"))
        for name, (ok, observed, expected) in entries.items()])
    return row.select(F.inline(packed))


def check_population(df: DataFrame, expected: int, flag: str | None = None, expected_true: int | None = None) -> DataFrame:
    row = df.agg(F.count("*").alias("n"), (F.count_if(F.col(flag)) if flag else F.lit(0)).alias("t"))
    entries = {"row_count": (F.col("n") == expected, F.col("n"), expected)}
    if flag:
        entries[f"{flag}_count"] = (F.col("t") == expected_true, F.col("t"), expected_true)
    return checks(row, entries)


def check_unique(df: DataFrame, keys: Sequence[str], expected: int | None = None) -> DataFrame:
    label = ",".join(keys)
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    row = per_key.agg(F.count_if(F.expr("n > 1")).alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    entries = {f"unique:{label}": (F.col("d") == 0, F.col("d"), 0)}
    if expected is not None:
        entries[f"rows:{label}"] = (F.col("n") == expected, F.col("n"), expected)
    return checks(row, entries)


def check_ranges(df: DataFrame, positive: Sequence[str] = (), nonnegative: Sequence[str] = (),
                 required: Sequence[str] = ()) -> DataFrame:
    """Rows that break 'finite and > 0', 'finite and >= 0' and 'not null', in one wide aggregate."""
    rules = [(f"positive:{x}", ~F.coalesce(finite(F.col(x)) > 0, F.lit(False))) for x in positive]
    rules += [(f"nonnegative:{x}", F.col(x).isNotNull() & ~F.coalesce(finite(F.col(x)) >= 0, F.lit(False))) for x in nonnegative]
    rules += [(f"present:{x}", F.col(x).isNull()) for x in required]
    row = df.agg(*[F.count_if(bad).alias(f"_r{i}") for i, (_, bad) in enumerate(rules)])
    return checks(row, {name: (F.col(f"_r{i}") == 0, F.col(f"_r{i}"), 0) for i, (name, _) in enumerate(rules)})


def check_flags(df: DataFrame, recomputed: Mapping[str, Column], nested: Sequence[str] = (),
                counts: Mapping[str, int] | None = None) -> DataFrame:
    """Flag recomputation, nesting (each later flag implies the earlier one) and expected counts."""
    entries, aggs = {}, []
    for i, (f, rule) in enumerate(recomputed.items()):
        aggs.append(F.count_if(~F.col(f).eqNullSafe(F.coalesce(rule, F.lit(False)))).alias(f"_d{i}"))
        entries[f"recompute:{f}"] = (F.col(f"_d{i}") == 0, F.col(f"_d{i}"), 0)
    for i, (outer, inner) in enumerate(zip(nested, nested[1:])):
        aggs.append(F.count_if(F.col(inner) & ~F.col(outer)).alias(f"_n{i}"))
        entries[f"implies:{inner}->{outer}"] = (F.col(f"_n{i}") == 0, F.col(f"_n{i}"), 0)
    for i, (f, n) in enumerate((counts or {}).items()):
        aggs.append(F.count_if(F.col(f)).alias(f"_c{i}"))
        entries[f"count:{f}"] = (F.col(f"_c{i}") == n, F.col(f"_c{i}"), n)
    return checks(df.agg(*aggs), entries)


def check_formula(df: DataFrame, formulas: Mapping[str, Column], tol: float = 1e-9) -> DataFrame:
    """Re-derive columns; null must match null, values must agree within the relative tolerance."""
    entries, aggs = {}, []
    for i, (x, rule) in enumerate(formulas.items()):
        off = ~(F.col(x).isNull().eqNullSafe(rule.isNull())) | (relative_error(F.col(x), rule) > tol)
        aggs.append(F.count_if(F.coalesce(off, F.lit(False))).alias(f"_f{i}"))
        entries[f"formula:{x}"] = (F.col(f"_f{i}") == 0, F.col(f"_f{i}"), 0)
    return checks(df.agg(*aggs), entries)


def check_rebuilt(reported: DataFrame, rebuilt: DataFrame, keys: Sequence[str], cols: Sequence[str], tol: float = 1e-8,
                  label: str = "rebuild") -> DataFrame:
    """A reported table against its rebuild: same keys, values within tolerance."""
    left = reported.select(*keys, *[F.col(x).alias(f"_a_{x}") for x in cols], F.lit(True).alias("_ina"))
    right = rebuilt.select(*keys, *[F.col(x).alias(f"_b_{x}") for x in cols], F.lit(True).alias("_inb"))
    if keys:
        both = _null_safe_join(left, right, keys, "full_outer")
    else:
        both = left.withColumn("_k", F.lit(1)).join(right.withColumn("_k", F.lit(1)), "_k", "full_outer")
    lost = F.count_if(F.col("_ina").isNull() | F.col("_inb").isNull())
    off = [F.count_if(~F.col(f"_a_{x}").isNull().eqNullSafe(F.col(f"_b_{x}").isNull())
                      | (F.abs(F.col(f"_a_{x}") - F.col(f"_b_{x}")) > tol * F.greatest(F.abs(f"_a_{x}"), F.lit(1.0)))) for x in cols]
    row = both.agg(lost.alias("_lost"), *[o.alias(f"_o{i}") for i, o in enumerate(off)])
    entries = {f"{label}:keys": (F.col("_lost") == 0, F.col("_lost"), 0)}
    entries.update({f"{label}:{x}": (F.col(f"_o{i}") == 0, F.col(f"_o{i}"), 0) for i, x in enumerate(cols)})
    return checks(row, entries)


def check_metrics(oof: DataFrame, reported: DataFrame, y: str, p: str, by: Sequence[str], tol: float = 1e-8) -> DataFrame:
    cols = ["mae", "rmse", "r2", "mdape", "smape", "signed_bias"]
    return check_rebuilt(reported, regression_metrics(oof, y, p, by), by, cols, tol, "metrics")


def check_intervals(draws: DataFrame, reported: DataFrame, cols: Sequence[str], by: Sequence[str], tol: float = 1e-8) -> DataFrame:
    return check_rebuilt(reported, bootstrap_ci(draws, cols, by), [*by, "column"], ["ci_low", "ci_high"], tol, "interval")


def check_summary(detail: DataFrame, summary: DataFrame, by: Sequence[str], count: str = "n") -> DataFrame:
    """A status summary equals the aggregation of its detail rows."""
    return check_rebuilt(summary, detail.groupBy(*by).agg(F.count("*").alias(count)), by, [count], 0.0, "summary")


def check_digest(df: DataFrame, frozen: Mapping[str, str], cols: Sequence[str] | None = None) -> DataFrame:
    """Current order-free digest, row count and schema against frozen values."""
    return checks(table_digest(df, cols), {k: (F.col(k).cast("string") == str(v), F.col(k), str(v)) for k, v in frozen.items()})


def verify_digests(requests: DataFrame, allowed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: whether its digest is in the frozen set ('verified', 'unverified')."""
    known = allowed.select(*by, "digest").distinct().withColumn("_known", F.lit(True))
    joined = join_many_to_one(requests, known, [*by, "digest"])
    return joined.withColumn("status", F.when(F.col("_known"), "verified").otherwise("unverified")).drop("_known")


def check_coverage(manifest: DataFrame, population: DataFrame, key: Sequence[str], group: str | None = None,
                   fold: str | None = None, n_folds: int | None = None) -> DataFrame:
    """Manifest holds each key once and exactly the population's keys; groups stay in one fold."""
    s = support(manifest, population, key)
    out = checks(s, {"manifest:same_support": (F.col("same_support"), F.col("n_only_a") + F.col("n_only_b") + F.col("n_repeated"), 0)})
    if group and fold:
        per_group = manifest.groupBy(group).agg(F.min(fold).alias("lo"), F.max(fold).alias("hi"))
        row = per_group.agg(F.count_if(F.col("lo") != F.col("hi")).alias("x"))
        out = out.unionByName(checks(row, {"manifest:isolated": (F.col("x") == 0, F.col("x"), 0)}))
    if fold and n_folds is not None:
        row = manifest.agg(F.countDistinct(fold).alias("k"))
        out = out.unionByName(checks(row, {"manifest:folds": (F.col("k") == n_folds, F.col("k"), n_folds)}))
    return out


def check_roles(manifest: DataFrame, contract: DataFrame) -> DataFrame:
    """Every contract column appears in the manifest with the same role, and no other x column does."""
    both = manifest.select("column", F.col("role").alias("have")).join(
        contract.select("column", F.col("role").alias("want")), "column", "full_outer")
    row = both.agg(F.count_if(F.expr("have is null")).alias("missing"), F.count_if(F.expr("want is null")).alias("extra"),
                   F.count_if(F.expr("have <> want")).alias("changed"))
    return checks(row, {f"roles:{x}": (F.col(x) == 0, F.col(x), 0) for x in ("missing", "extra", "changed")})


def check_revisions(manifest: DataFrame, key: str, revision: str, access: str, allowed: Sequence[str],
                    static_only: str, expected: int) -> DataFrame:
    """Pinned-revision manifest: 40 hex digits, known access class, static-only, expected count."""
    row = manifest.agg(
        F.countDistinct(key).alias("n"),
        F.count_if(~F.coalesce(F.col(revision).rlike("^[0-9a-f]{40}$"), F.lit(False))).alias("rev"),
        F.count_if(~F.coalesce(F.col(access).isin(*allowed), F.lit(False))).alias("acc"),
        F.count_if(~F.coalesce(F.col(static_only), F.lit(False))).alias("sta"))
    return checks(row, {"revisions:count": (F.col("n") == expected, F.col("n"), expected),
                        "revisions:hex40": (F.col("rev") == 0, F.col("rev"), 0),
                        "revisions:access": (F.col("acc") == 0, F.col("acc"), 0),
                        "revisions:static_only": (F.col("sta") == 0, F.col("sta"), 0)})


def boundary_violations(cols: Sequence[str], prefix: str = "x_", forbid: Sequence[str] = (),
                        allow: Sequence[str] = ()) -> list[str]:
    """Columns outside the allowed namespace or containing a forbidden fragment."""
    return [x for x in cols if x not in allow and (not x.startswith(prefix) or any(f in x for f in forbid))]


def assert_boundary(cols: Sequence[str], prefix: str = "x_", forbid: Sequence[str] = (), allow: Sequence[str] = ()) -> None:
    bad = boundary_violations(cols, prefix, forbid, allow)
    if bad:
        raise ValueError(f"feature boundary violated by {bad}")


def check_boundary(df: DataFrame, bundles: Mapping[str, Sequence[str]], roles: Mapping[str, str], allowed_roles: Sequence[str],
                   prefix: str = "x_", forbid: Sequence[str] = (), complete: bool = True) -> DataFrame:
    """Per bundle: role, prefix and fragment rules (plan time) and completeness (one aggregate for all bundles)."""
    columns = list(dict.fromkeys(x for cols in bundles.values() for x in cols))
    row = df.agg(F.count("*").alias("_n"), *[F.count(x).alias(f"_c{i}") for i, x in enumerate(columns)])
    entries = {}
    for name, cols in bundles.items():
        bad = boundary_violations(cols, prefix, forbid) + [x for x in cols if roles.get(x) not in allowed_roles]
        entries[f"boundary:{name}"] = (F.lit(not bad), F.lit(len(bad)), 0)
        if complete:
            gaps = reduce(lambda a, b: a + b, [F.col("_n") - F.col(f"_c{columns.index(x)}") for x in cols], F.lit(0))
            entries[f"complete:{name}"] = (gaps == 0, gaps, 0)
    return checks(row, entries)


def check_nested_metadata(meta: DataFrame) -> DataFrame:
    """Nested-CV metadata rows: inner/outer isolation, full inner coverage and a correct argmin.

    Columns: ``train_groups, test_groups, inner`` (array of (train, validation) group arrays),
    ``scores`` (null = failed candidate) and ``selected``.
    """
    inner, train, test = F.col("inner"), F.col("train_groups"), F.col("test_groups")
    leaks = F.size(F.array_intersect(train, test)) > 0
    crossing = F.exists(inner, lambda s: F.size(F.array_intersect(s["train"], s["validation"])) > 0)
    outside = F.exists(inner, lambda s: F.size(F.array_except(F.concat(s["train"], s["validation"]), train)) > 0)
    covered = F.flatten(F.transform(inner, lambda s: s["validation"]))
    partial = (F.size(covered) != F.size(F.array_distinct(covered))) | (F.size(F.array_except(train, covered)) > 0)
    scored = F.transform(F.col("scores"), lambda s: F.coalesce(s, F.lit(float("inf"))))
    wrong = F.col("selected") != F.array_position(scored, F.array_min(scored)) - 1
    row = meta.agg(*[F.count_if(F.coalesce(x, F.lit(True))).alias(n) for n, x in {
        "outer_leak": leaks, "inner_leak": crossing, "inner_outside": outside, "inner_partial": partial, "argmin": wrong}.items()])
    return checks(row, {f"nested:{n}": (F.col(n) == 0, F.col(n), 0)
                        for n in ("outer_leak", "inner_leak", "inner_outside", "inner_partial", "argmin")})


def check_nested_rows(outer: DataFrame, inner: DataFrame, meta: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """The same gates from rows, as ``nested_cv`` leaves them: no array of groups is built.

    ``outer`` (group, fold) and ``inner`` (``_set``: the held-out fold, group, ``_inner``) are fold manifests, ``meta`` (fold, ``scores``, ``selected``) the outcome of each search.
    One grouped count per held-out fold and group tells held-out groups among the inner ones, groups in two inner folds, unknown ones and missing ones.
    """
    sets = meta.select(F.col(fold).alias("_set")).distinct()  # one row a fold
    held = F.col(fold) == F.col("_set")
    want = outer.select(group, fold).crossJoin(F.broadcast(sets)).select("_set", group, (~held).cast("int").alias("_t"), held.cast("int").alias("_h"), F.lit(None).cast("int").alias("_inner"))
    have = inner.select("_set", group, F.lit(0).alias("_t"), F.lit(0).alias("_h"), F.col("_inner").cast("int").alias("_inner"))
    cells = want.unionByName(have).groupBy("_set", group).agg(
        F.max("_t").alias("_t"), F.max("_h").alias("_h"), F.min("_inner").alias("_low"), F.max("_inner").alias("_high"))
    train, test, inside = F.col("_t") == 1, F.col("_h") == 1, F.col("_low").isNotNull()
    row = cells.agg(*[F.count_if(x).alias(n) for n, x in {
        "outer_leak": test & (train | inside), "inner_leak": F.col("_low") < F.col("_high"), "inner_outside": inside & ~train & ~test, "inner_partial": train & ~inside}.items()])
    scored = F.transform(F.col("scores"), lambda s: F.coalesce(s, F.lit(float("inf"))))
    wrong = meta.agg(F.count_if(F.coalesce(F.col("selected") != F.array_position(scored, F.array_min(scored)) - 1, F.lit(True)))).scalar()
    return checks(row.withColumn("argmin", wrong), {f"nested:{n}": (F.col(n) == 0, F.col(n), 0) for n in ("outer_leak", "inner_leak", "inner_outside", "inner_partial", "argmin")})


def check_interpretation(rows: DataFrame, scope: str, fold: str, feature: str, folds: int, features: int) -> DataFrame:
    """Every scope covers all folds and all features."""
    per_scope = rows.groupBy(scope).agg(F.countDistinct(fold).alias("k"), F.countDistinct(feature).alias("f"))
    row = per_scope.agg(F.count_if(F.col("k") != folds).alias("k"), F.count_if(F.col("f") != features).alias("f"))
    return checks(row, {"interpretation:folds": (F.col("k") == 0, F.col("k"), 0),
                        "interpretation:features": (F.col("f") == 0, F.col("f"), 0)})


def check_fingerprints(stored: DataFrame, rebuilt: DataFrame, key: str, col: str = "fingerprint") -> DataFrame:
    """Stored fingerprints equal the rebuilt ones, key by key."""
    both = stored.select(key, F.col(col).alias("_s")).join(rebuilt.select(key, F.col(col).alias("_r")), key, "full_outer")
    row = both.agg(F.count_if(~F.col("_s").eqNullSafe(F.col("_r"))).alias("x"))
    return checks(row, {"fingerprints": (F.col("x") == 0, F.col("x"), 0)})


def check_paired_totals(effects: DataFrame, oof: DataFrame, by: Sequence[str], rows: str = "n_rows") -> DataFrame:
    """Paired tables count exactly the rows of the predictions they compare."""
    return check_rebuilt(effects.select(*by, rows), oof.groupBy(*by).agg(F.count("*").alias(rows)), by, [rows], 0.0, "paired_totals")


def run_checks(frames: Sequence[DataFrame], enforce: bool = True) -> DataFrame:
    """All check rows as one receipt; raises on the first failures (at most 20 named) when enforced."""
    receipt = reduce(DataFrame.unionByName, frames)
    if enforce:
        failed = receipt.where(F.col("status") != "pass").limit(20).collect()
        if failed:
            raise ValueError("checks failed: " + "; ".join(f"{r['name']} observed {r['observed']}, expected {r['expected']}" for r in failed))
    return receipt
