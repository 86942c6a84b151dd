"""Distributed fits: preprocessing, nested group CV, interpretation, stress and final models.

Every fit is an MLlib job over the whole training partition.  The driver iterates
over (fold, candidate) only; what it holds is a handful of medians, category
names (beyond ``max_categories`` they stay in a stored table) and scores.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, PCA, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, LinearRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.numeric import high_value_weights, restore_target, transform_target
from plumbline.functions.predicates import complete_cases
from plumbline.operators.evaluation import per_unit_metrics, regression_metrics, summarise_cells
from plumbline.operators.joins import attach_folds, join_many_to_one
from plumbline.operators.ordering import hash_index, permuted, quantile_table, row_index
from plumbline.operators.profile import value_counts
from plumbline.operators.splits import group_folds, random_splits
from plumbline.plans import gram, trees
from plumbline.session import cut_lineage, table_path

INDICATOR = "__missing"


@dataclass(frozen=True)
class Spec:
    """What is fitted: columns, target, strategy (unit, transform), algorithm, loss and weighting."""

    numeric: Sequence[str]
    categorical: Sequence[str]
    target: str
    algorithm: str = "ridge"
    unit: str | None = None
    transform: str = "raw"
    objective: str = "squared"
    weighted: bool = False
    seed: int = 42
    labels: Mapping[str, object] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.categorical]


class Preprocessor:
    """Median impute with missing indicators, mode impute, one-hot (unknown -> zeros), optional scaling.

    All statistics come from the training rows alone.  More than ``max_categories`` names in all are numbered by range partitions,
    stay in a stored table and are joined to the rows; the features are the same either way.
    """

    def __init__(self, numeric: Sequence[str], categorical: Sequence[str], scale: bool = False,
                 indicators: bool = True, max_categories: int = 10_000):
        self.numeric, self.categorical = list(numeric), list(categorical)
        self.scale, self.indicators, self.max_categories = scale, indicators, max_categories

    def fit(self, train: DataFrame) -> Preprocessor:
        # the constant column makes the row count come with the medians, in the same pass
        table = quantile_table(train.select(*self.numeric, F.lit(1).alias("__rows")), [*self.numeric, "__rows"], [0.5])
        found = {r["column"]: (r["n"], r["q"][0] if r["q"] else None) for r in table.collect()}
        # a column without any value is kept as zeros
        self.medians = {c: found[c][1] if found[c][1] is not None else 0.0 for c in self.numeric}
        self.flagged = [c for c in self.numeric if self.indicators and found[c][0] < found["__rows"][0]]
        self.labels = self._categories(train)
        filled = self._fill(train)
        inputs = [*self.numeric, *[c + INDICATOR for c in self.flagged]]
        self.moments: dict[str, tuple[float, float]] = {}
        if self.scale and inputs:
            row = filled.agg(*[x for c in inputs for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
            self.moments = {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in inputs}
        self.stages = []
        named = [c for c in self.categorical if self.labels.get(c) or self.sizes.get(c)]  # a column without any name has no positions
        if named:
            index, hot = [f"{c}__i" for c in named], [f"{c}__h" for c in named]
            indexers = [] if self.sizes else [StringIndexerModel.from_labels(self.labels[c], c, i, "keep") for c, i in zip(named, index)]
            indexed = reduce(lambda rows, stage: stage.transform(rows), indexers, self._number(filled))
            # sizes come from the labels, so this reads no rows; the last slot is "unknown" and is dropped
            encoder = OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True).fit(indexed)
            self.stages = [*indexers, encoder]
            inputs = [*inputs, *hot]
        self.assembler = VectorAssembler(inputCols=inputs, outputCol="features")
        return self

    def _categories(self, train: DataFrame) -> dict[str, list[str]]:
        """Sorted category names per column (and the modes); none where there are more than ``max_categories`` in all: those are stored."""
        self.modes: dict[str, str] = {}
        self.sizes: dict[str, int] = {}
        if not self.categorical:
            return {}
        counts = value_counts(train, self.categorical).where(F.col("value").isNotNull())
        rows = counts.limit(self.max_categories + 1).collect()
        if len(rows) > self.max_categories:
            self._store_names(cut_lineage(counts))
            return {}
        labels: dict[str, list[str]] = {c: [] for c in self.categorical}
        for r in sorted(rows, key=lambda r: (-r["n"], r["value"])):  # most frequent, then first by name
            self.modes.setdefault(r["column"], r["value"])
            labels[r["column"]].append(r["value"])
        return {c: sorted(v) for c, v in labels.items()}

    def _store_names(self, counts: DataFrame) -> None:
        best = F.min_by("value", F.struct(-F.col("n"), "value"))
        for r in counts.groupBy("column").agg(best.alias("mode"), F.count("*").alias("n")).collect():
            self.modes[r["column"]], self.sizes[r["column"]] = r["mode"], r["n"]
        self.names = table_path(counts.sparkSession)
        row_index(counts.select("column", "value"), ["value"], ["column"], "place").write.parquet(self.names)

    def _number(self, filled: DataFrame) -> DataFrame:
        """Joins the place of each stored name; names that training did not have come last."""
        for c, n in self.sizes.items():
            known = filled.sparkSession.read.parquet(self.names).where(F.col("column") == c).select(F.col("value").alias(c), F.col("place").alias("__place"))
            place = F.coalesce(F.col("__place"), F.lit(n)).cast("double")
            filled = join_many_to_one(filled, known, c).withColumn(f"{c}__i", place.alias(f"{c}__i", metadata={"ml_attr": {"type": "nominal", "num_vals": n + 1}})).drop("__place")
        return filled

    def _fill(self, df: DataFrame) -> DataFrame:
        cols = {c + INDICATOR: F.col(c).isNull().cast("double") for c in self.flagged}
        cols.update({c: F.coalesce(F.col(c).cast("double"), F.lit(float(self.medians[c]))) for c in self.numeric})
        cols.update({c: F.coalesce(F.col(c).cast("string"), F.lit(self.modes.get(c, ""))) for c in self.categorical})
        return df.withColumns(cols) if cols else df

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns plus ``features``."""
        held = df.select(F.struct(*keep).alias("_keep"), *[c for c in self.numeric + self.categorical]) if keep else df
        filled = self._fill(held)
        if self.moments:
            filled = filled.withColumns({c: (F.col(c) - m) / s for c, (m, s) in self.moments.items()})
        filled = self._number(filled)
        for stage in self.stages:
            filled = stage.transform(filled)
        out = self.assembler.transform(filled)
        return out.select("_keep.*", "features") if keep else out


def linear_penalty(alpha: float, l1_ratio: float, sigma: float, n: int, ridge: bool) -> tuple[float, float]:
    """(regParam, elasticNetParam) of MLlib for the usual penalties.

    MLlib scales the target by its standard deviation before it penalises, so the
    squared term needs a factor sigma, and the ridge penalty is per row.
    """
    if ridge:
        return alpha * sigma / n, 0.0
    total = alpha * (l1_ratio + (1 - l1_ratio) * sigma)
    return total, (alpha * l1_ratio / total if total else 0.0)


_SETTINGS = ("numeric", "categorical", "scale", "indicators", "max_categories")
_LEARNED = ("medians", "flagged", "labels", "modes", "moments", "sizes")


class FittedModel:
    """Preprocessing and estimator with the target strategy needed to restore predictions."""

    def __init__(self, spec: Spec, prep: Preprocessor | None, model: object):
        self.spec, self.prep, self.model = spec, prep, model

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """All columns of ``df`` plus the prediction in original units."""
        spec = self.spec
        unit = F.col(spec.unit) if spec.unit else None
        if self.prep is None:
            return df.withColumn(name, restore_target(F.lit(self.model), spec.transform, unit))
        scored = self.model.transform(self.prep.transform(df, df.columns))
        return scored.withColumn(name, restore_target(F.col("_raw_prediction"), spec.transform, unit)).drop(
            "features", "_raw_prediction")

    def linear(self, values: Mapping[str, Column]) -> Column | None:
        """The prediction of a linear model as one expression, with ``values`` in place of the columns they are named after; None for other models and for many categories."""
        prep, spec = self.prep, self.spec
        if prep is None or not isinstance(self.model, LinearRegressionModel) or prep.sizes or sum(map(len, prep.labels.values())) > EXPRESSION_LABELS:
            return None
        def of(c: str) -> Column:
            return values.get(c, F.col(c))
        weights = iter(self.model.coefficients.toArray().tolist())
        inputs = {c: F.coalesce(of(c).cast("double"), F.lit(float(prep.medians[c]))) for c in prep.numeric}
        inputs.update({c + INDICATOR: of(c).isNull().cast("double") for c in prep.flagged})
        terms = [F.lit(float(self.model.intercept))]
        for c, v in inputs.items():
            mean, size = prep.moments.get(c, (0.0, 1.0))
            terms.append((v - mean) / size * next(weights))
        for c in prep.categorical:
            if prep.labels.get(c):
                known = F.create_map(*[F.lit(x) for label in prep.labels[c] for x in (label, next(weights))])
                terms.append(F.coalesce(F.try_element_at(known, F.coalesce(of(c).cast("string"), F.lit(prep.modes[c]))), F.lit(0.0)))
        return restore_target(sum(terms[1:], terms[0]), spec.transform, of(spec.unit) if spec.unit else None)

    def save(self, path: str) -> None:
        """Write the model below ``path``, which must not exist yet."""
        prep = self.prep
        state = {"spec": asdict(self.spec), "mean": None if prep else self.model, "prep": prep and {k: getattr(prep, k) for k in (*_SETTINGS, *_LEARNED)}}
        SparkSession.active().createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.text(f"{path}/state")
        if prep:
            PipelineModel([*prep.stages, prep.assembler, self.model]).write().save(f"{path}/stages")
            if prep.sizes:
                SparkSession.active().read.parquet(prep.names).write.parquet(f"{path}/names")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedModel:
        state = json.loads(spark.read.text(f"{path}/state").first()[0])
        spec, kept = Spec(**state["spec"]), state["prep"]
        if kept is None:
            return FittedModel(spec, None, state["mean"])
        prep = Preprocessor(**{k: kept[k] for k in _SETTINGS})
        for name in _LEARNED:
            setattr(prep, name, kept[name])
        prep.names = f"{path}/names"
        *prep.stages, prep.assembler, model = PipelineModel.load(f"{path}/stages").stages
        return FittedModel(spec, prep, model)


#: category names up to which a linear prediction is written as an expression
EXPRESSION_LABELS = 256
#: features up to which the normal equations can be solved
NORMAL_FEATURES = 4096


def _solver(ready: DataFrame) -> dict[str, object]:
    """The closed form where MLlib has one, else iterations to nearly the same minimum."""
    first = ready.select("features").first()
    if first is None or first["features"].size <= NORMAL_FEATURES:
        return {"solver": "normal"}
    return {"solver": "l-bfgs", "tol": 1e-10, "maxIter": 1000}


def fit(train: DataFrame, spec: Spec, params: Mapping[str, object]) -> FittedModel:
    unit = F.col(spec.unit) if spec.unit else None
    rows = train.withColumn("_y", transform_target(F.col(spec.target), spec.transform, unit))
    if spec.algorithm == "mean":
        return FittedModel(spec, None, rows.agg(F.avg("_y").alias("m")).first()["m"])
    if spec.weighted:
        rows = high_value_weights(rows, spec.target, name="_w")
    prep = Preprocessor(spec.numeric, spec.categorical, scale=spec.algorithm in ("ridge", "elastic_net")).fit(rows)
    ready = prep.transform(rows, ["_y", "_w"] if spec.weighted else ["_y"]).persist()
    try:
        common = {"featuresCol": "features", "labelCol": "_y", "predictionCol": "_raw_prediction"}
        if spec.weighted:
            common["weightCol"] = "_w"
        if spec.algorithm in ("ridge", "elastic_net"):
            stats = ready.agg(F.count("*").alias("n"), F.stddev_pop("_y").alias("s")).first()
            reg, mix = linear_penalty(float(params.get("alpha", 1.0)), float(params.get("l1_ratio", 0.5)),
                                      stats["s"] or 1.0, stats["n"], spec.algorithm == "ridge")
            estimator = LinearRegression(regParam=reg, elasticNetParam=mix, standardization=False, **_solver(ready), **common)
        elif spec.algorithm == "forest":
            estimator = RandomForestRegressor(seed=spec.seed, **common, **params)
        elif spec.algorithm == "boosted":
            estimator = GBTRegressor(seed=spec.seed, lossType=spec.objective, **common, **params)
        else:
            raise ValueError(f"unknown algorithm: {spec.algorithm}")
        return FittedModel(spec, prep, estimator.fit(ready))
    finally:
        ready.unpersist()


def by_products(spec: Spec) -> bool:
    """Whether sums of products are enough to fit: linear, and the same weight for all rows."""
    return spec.algorithm in ("ridge", "elastic_net") and not spec.weighted


def fold_values(df: DataFrame, fold: str) -> list[int]:
    """Fold numbers; each is fitted on its own, so there are few of them."""
    return sorted(r[0] for r in df.select(fold).distinct().collect())


def oof_fixed(df: DataFrame, fold: str, spec: Spec, params: Mapping[str, object]) -> DataFrame:
    """Out-of-fold predictions with one fixed parameter set; linear fits come from sums of products, trees from histograms, all folds at once."""
    if by_products(spec):
        found = gram.out_of_fold(df, fold, spec, params)
        if found is not None:
            return _labelled(found, spec)
    if spec.algorithm in ("forest", "boosted"):
        found = trees.out_of_fold(df, fold, spec, params)
        if found is not None:
            return _labelled(found, spec)
    parts = []
    for k in fold_values(df, fold):
        model = fit(df.where(F.col(fold) != k), spec, params)
        parts.append(model.predict(df.where(F.col(fold) == k)))
    return _labelled(reduce(DataFrame.unionByName, parts), spec)


def _labelled(df: DataFrame, spec: Spec) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in spec.labels.items()}) if spec.labels else df


def oof_linear(df: DataFrame, fold: str, spec: Spec, alpha: float, l1_ratio: float | None = None) -> DataFrame:
    """Ridge, or elastic net when ``l1_ratio`` is given."""
    kind = "ridge" if l1_ratio is None else "elastic_net"
    return oof_fixed(df, fold, replace(spec, algorithm=kind), {"alpha": alpha, "l1_ratio": l1_ratio or 0.0})


def oof_forest(df: DataFrame, fold: str, spec: Spec, **params: object) -> DataFrame:
    return oof_fixed(df, fold, replace(spec, algorithm="forest"), params)


def oof_gbt(df: DataFrame, fold: str, spec: Spec, loss: str = "absolute", **params: object) -> DataFrame:
    return oof_fixed(df, fold, replace(spec, algorithm="boosted", objective=loss), params)


@dataclass
class Selection:
    """Outcome of an inner candidate search."""

    selected: int
    scores: list[float | None]
    failures: list[str | None]


def select_by_group_cv(train: DataFrame, group: str, spec: Spec, candidates: Sequence[Mapping[str, object]],
                       inner_k: int = 3) -> Selection:
    """Row-weighted validation MAE on restored totals over inner group folds; lowest score, then lowest index."""
    if len(candidates) == 1:
        return Selection(0, [None], [None])
    inner = group_folds(train, group, inner_k, seed=spec.seed, name="_inner")
    needed = list(dict.fromkeys([group, spec.target, *([spec.unit] if spec.unit else []), *spec.columns]))
    rows = cut_lineage(attach_folds(train.select(*needed), inner, group, "_inner"))
    folds = fold_values(rows, "_inner")
    if len(folds) < 2:
        return Selection(0, [None] * len(candidates), [None] * len(candidates))
    scores: list[float | None] = []
    failures: list[str | None] = []
    for params in candidates:
        try:
            total, n = 0.0, 0
            for k in folds:
                model = fit(rows.where(F.col("_inner") != k), spec, params)
                r = model.predict(rows.where(F.col("_inner") == k)).agg(
                    F.sum(F.abs(F.col("prediction") - F.col(spec.target))).alias("e"), F.count("*").alias("n")).first()
                total, n = total + r["e"], n + r["n"]
            scores.append(total / n)
            failures.append(None)
        except Exception as error:  # a failed candidate loses; it does not end the search
            scores.append(None)
            failures.append(f"{type(error).__name__}: {error}"[:300])
    ranked = [(s, i) for i, s in enumerate(scores) if s is not None]
    if not ranked:
        raise ValueError(f"all candidates failed: {failures}")
    return Selection(min(ranked)[1], scores, failures)


def inner_manifest(df: DataFrame, fold: str, group: str, folds: Sequence[int], inner_k: int = 3, seed: int = 42) -> DataFrame:
    """(``_set``, group, ``_inner``): for every held-out fold the inner folds of the groups outside it; what ``nested_cv`` searches on and ``check_nested_rows`` audits."""
    sizes = cut_lineage(df.groupBy(fold, group).agg(F.count("*").alias("_rows")))
    outside = F.filter(F.array(*[F.lit(k).cast("int") for k in folds]), lambda k: k != F.col(fold))
    parts = sizes.select(F.explode(outside).alias("_set"), group, "_rows")
    return cut_lineage(group_folds(parts, group, inner_k, seed, "_inner", ["_set"], F.col("_rows")).select("_set", group, "_inner"))


NESTED = "fold int, selected int, scores array<double>, train_rows long, test_rows long, train_groups long, failures array<string>"


def nested_cv(df: DataFrame, fold: str, group: str, spec: Spec, candidates: Sequence[Mapping[str, object]],
              inner_k: int = 3) -> tuple[DataFrame, DataFrame]:
    """(predictions, metadata): candidate search inside each outer training part, refit, predict the held-out fold.

    Metadata rows (fold, selected, scores, train_rows, test_rows, train_groups, failures) describe each search.
    """
    parts, meta = [], []
    sizes = {r[fold]: r for r in df.groupBy(fold).agg(F.count("*").alias("n"), F.countDistinct(group).alias("g")).collect()}
    rows, groups = sum(r["n"] for r in sizes.values()), sum(r["g"] for r in sizes.values())  # groups never cross folds
    if by_products(spec):
        # nothing is compared where there is one candidate
        inner = inner_manifest(df, fold, group, sorted(sizes), inner_k, spec.seed) if len(candidates) > 1 else None
        found = gram.nested(df, fold, inner, group, spec, candidates)
        if found is not None:
            out, scores, choice = found
            meta = [(k, choice[k], scores[k], rows - sizes[k]["n"], sizes[k]["n"], groups - sizes[k]["g"], [None] * len(candidates)) for k in sorted(choice)]
            return _labelled(out.withColumnRenamed("_candidate", "selected_candidate"), spec), df.sparkSession.createDataFrame(meta, NESTED)
    for k in sorted(sizes):
        train, test = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        choice = select_by_group_cv(train, group, spec, candidates, inner_k)
        model = fit(train, spec, candidates[choice.selected])
        parts.append(model.predict(test).withColumn("selected_candidate", F.lit(choice.selected)))
        size = sizes[k]
        meta.append((k, choice.selected, choice.scores, rows - size["n"], size["n"], groups - size["g"], choice.failures))
    return _labelled(reduce(DataFrame.unionByName, parts), spec), df.sparkSession.createDataFrame(meta, NESTED)


def oof_full(df: DataFrame, group: str, spec: Spec, candidates: Sequence[Mapping[str, object]], k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(predictions, fold manifest) of nested CV over every row."""
    folds = cut_lineage(group_folds(df, group, k, seed=spec.seed))
    predictions, _ = nested_cv(cut_lineage(attach_folds(df, folds, group)), "fold", group, spec, candidates)
    return predictions, folds


def fit_final(df: DataFrame, group: str, spec: Spec, candidates: Sequence[Mapping[str, object]]) -> tuple[FittedModel, dict[str, object]]:
    """Group-CV choice on the full support, then one refit on all rows."""
    choice = select_by_group_cv(df, group, spec, candidates)
    model = fit(df, spec, candidates[choice.selected])
    return model, {"selected": choice.selected, "params": dict(candidates[choice.selected]), "scores": choice.scores,
                   "failures": choice.failures, "n_rows": df.count()}


# ---- comparisons -----------------------------------------------------------------------------

def compare_targets(df: DataFrame, fold: str, group: str, specs: Sequence[Spec], candidates: Sequence[Mapping[str, object]]) -> DataFrame:
    """OOF rows in original units for several (target, transform, unit) strategies."""
    parts = []
    for s in specs:
        predictions, _ = nested_cv(df, fold, group, s, candidates)
        parts.append(predictions.withColumns({
            "target": F.lit(s.target), "transform": F.lit(s.transform), "strategy": F.lit("per_unit" if s.unit else "direct"),
            "y_true": F.col(s.target).cast("double")}))
    return reduce(DataFrame.unionByName, parts)


def compare_bundles(df: DataFrame, group: str, spec: Spec, bundles: Mapping[str, Mapping[str, Sequence[str]]],
                    params: Mapping[str, object], k: int = 5) -> DataFrame:
    """Same complete-case rows and same folds for every bundle; one metrics row per bundle."""
    support = list(dict.fromkeys(c for b in bundles.values() for c in b["columns"]))
    rows = complete_cases(df, support)
    rows = cut_lineage(attach_folds(rows, group_folds(rows, group, k, seed=spec.seed), group))
    parts = [oof_fixed(rows, "fold", replace(spec, numeric=b["numeric"], categorical=b["categorical"], labels={"bundle": name}), params)
             for name, b in bundles.items()]
    return summarise_cells(reduce(DataFrame.unionByName, parts), spec.target, "prediction", ["bundle"])


def compare_representations(df: DataFrame, fold: str, spec: Spec, column: str, params: Mapping[str, object]) -> DataFrame:
    """Predictions with and without one categorical column on the same rows and folds."""
    without = [c for c in spec.categorical if c != column]
    return oof_fixed(df, fold, replace(spec, labels={"variant": f"with_{column}"}), params).unionByName(
        oof_fixed(df, fold, replace(spec, categorical=without, labels={"variant": f"without_{column}"}), params))


def run_strategies(df: DataFrame, fold: str, spec: Spec, strategies: Sequence[Mapping[str, object]], params: Mapping[str, object]) -> DataFrame:
    """Objective × weighting runs; evaluation stays unweighted.  Trees of all runs grow from the same stored rows, in the same passes."""
    specs = [replace(spec, objective=s["objective"], weighted=bool(s["weighted"]), labels={"strategy_id": s["strategy_id"]}) for s in strategies]
    found = trees.out_of_fold_runs(df, fold, specs, params) if spec.algorithm == "boosted" else None
    parts = [_labelled(out, s) for out, s in zip(found, specs)] if found else [oof_fixed(df, fold, s, params) for s in specs]
    return reduce(DataFrame.unionByName, parts)


def stress(df: DataFrame, manifest: DataFrame, on: Sequence[str], spec: Spec, params: Mapping[str, object], scheme: str,
           slice_col: str | None = None) -> DataFrame:
    """Fixed parameters refitted per held-out group (inside each slice when given); rows carry a post-hoc flag."""
    rows = cut_lineage(join_many_to_one(df, manifest.select(*on, "fold"), list(on), "inner"))
    flags = {"scheme": F.lit(scheme), "post_hoc": F.lit(True)}
    if by_products(spec):
        found = gram.out_of_fold(rows, "fold", spec, params, [slice_col] if slice_col else [])
        if found is not None:
            return _labelled(found, spec).withColumns(flags)
    parts = []
    slices = sorted(r[0] for r in rows.select(slice_col).distinct().collect()) if slice_col else [None]
    for s in slices:
        part = rows.where(F.col(slice_col) == s) if slice_col else rows
        parts.append(oof_fixed(part, "fold", spec, params))
    return reduce(DataFrame.unionByName, parts).withColumns(flags)


def stress_metrics(predictions: DataFrame, y: str, units: str, by: Sequence[str]) -> DataFrame:
    wide = predictions.groupBy(*by).agg(*[v.alias(k) for k, v in per_unit_metrics(y, "prediction", units).items()])
    return join_many_to_one(regression_metrics(predictions, y, "prediction", by), wide, by, "inner")


def ladder(df: DataFrame, key: str, config: str, group: str, family: str, spec: Spec, params: Mapping[str, object],
           repeats: int = 3, test: float = 0.2, k: int = 5) -> DataFrame:
    """Metrics of one fixed model under ever harder splits: random, configuration, group, family."""
    parts = []
    splits = cut_lineage(random_splits(df, key, test, repeats, spec.seed))
    for r in range(repeats):
        marked = cut_lineage(join_many_to_one(df, splits.where(F.col("repeat") == r).select(key, "is_test"), key, "inner"))
        model = fit(marked.where(~F.col("is_test")), spec, params)
        scored = model.predict(marked.where(F.col("is_test")))
        parts.append(scored.select(F.lit("random").alias("scheme"), F.lit(r).alias("repeat"), spec.target, "prediction"))
    for scheme, column in (("configuration", config), ("group", group), ("family", family)):
        rows = cut_lineage(attach_folds(df, group_folds(df, column, k, seed=spec.seed), column))
        parts.append(oof_fixed(rows, "fold", spec, params).select(
            F.lit(scheme).alias("scheme"), F.lit(0).alias("repeat"), spec.target, "prediction"))
    per_repeat = regression_metrics(reduce(DataFrame.unionByName, parts), spec.target, "prediction", ["scheme", "repeat"])
    return per_repeat.groupBy("scheme").agg(F.count("*").alias("repeats"), F.avg("mae").alias("mae"), F.stddev_samp("mae").alias("mae_std"),
                                            F.avg("rmse").alias("rmse"), F.avg("r2").alias("r2"))


# ---- interpretation --------------------------------------------------------------------------

def _spread(df: DataFrame, columns: Sequence[str], values: Mapping[str, Column], keep: Sequence[Column | str]) -> DataFrame:
    """Each row once per varied column, with that column replaced by ``values[column]``."""
    def variant(target: str) -> Column:
        fields = [(values[c] if c == target else F.col(c)).alias(c) for c in columns]
        return F.struct(F.lit(target).alias("feature"), *fields)
    return df.select(*keep, F.inline(F.array(*[variant(c) for c in values])))


def permutation_importance(model: FittedModel, df: DataFrame, key: Sequence[str], features: Sequence[str] | None = None,
                           repeats: int = 10, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """MAE increase per feature: mean and sample std over seeded permutations.

    Rows stand in hash order; a keyed permutation tells each row, for every repeat, whose values it borrows.  All repeats share one indexed table, one join and one
    prediction, and no task holds a whole column.
    """
    spec = model.spec
    features = list(features or spec.columns)
    fixed = [c for c in dict.fromkeys([spec.target, spec.unit, *by]) if c and c not in spec.columns]
    base = cut_lineage(hash_index(df.select(*key, *fixed, *[c for c in spec.columns if c not in key]), key, seed, name="_i"))
    n = base.count()
    error = F.abs(F.col("prediction") - F.col(spec.target))
    reference = model.predict(df).groupBy(*by).agg(F.avg(error).alias("_ref"))
    donors = base.select(F.col("_i").alias("_d"), *[F.col(c).alias(f"_p_{c}") for c in features])
    each = base.select("_i", *fixed, *spec.columns, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    # Spark takes the rows of all repeats for no more than those of one and would send them to every executor by way of the driver
    mixed = each.withColumn("_d", permuted(F.col("_i"), n, seed, F.col("repeat"))).join(donors.hint("merge"), "_d")
    alone = {c: model.linear({c: F.col(f"_p_{c}")}) for c in features}
    if all(p is not None for p in alone.values()):  # all features of a row at once
        wide = mixed.groupBy(*by, "repeat").agg(*[F.avg(F.abs(p - F.col(spec.target))).alias(f"_e{i}") for i, p in enumerate(alone.values())])
        packed = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_e{i}").alias("_mae")) for i, c in enumerate(features)])
        runs = wide.select(*by, "repeat", F.inline(packed))
    else:
        rows = _spread(mixed, spec.columns, {c: F.col(f"_p_{c}") for c in features}, [*fixed, "repeat"])
        runs = model.predict(rows).groupBy(*by, "feature", "repeat").agg(F.avg(error).alias("_mae"))
    runs = (join_many_to_one(runs, reference, list(by)) if by else runs.withColumn("_ref", reference.select("_ref").scalar()))
    runs = runs.withColumn("increase", F.col("_mae") - F.col("_ref"))
    return runs.groupBy(*by, "feature").agg(F.avg("increase").alias("importance_mean"),
                                            F.stddev_samp("increase").alias("importance_std"), F.count("*").alias("repeats"))


def fold_importance(df: DataFrame, fold: str, spec: Spec, params: Mapping[str, object], key: Sequence[str], repeats: int = 10, seed: int = 42) -> DataFrame:
    """``permutation_importance`` per outer fold: fitted without the fold, permuted and scored on its rows alone."""
    parts = []
    for k in fold_values(df, fold):
        model = fit(df.where(F.col(fold) != k), spec, params)
        found = permutation_importance(model, df.where(F.col(fold) == k), key, repeats=repeats, seed=seed)
        parts.append(cut_lineage(found).withColumn(fold, F.lit(k)))
    return reduce(DataFrame.unionByName, parts)


def partial_dependence(model: FittedModel, train: DataFrame, df: DataFrame, features: Sequence[str], points: int = 9,
                       low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(feature, grid_value, mean, std): predictions with the feature set to distinct training quantiles.

    The grid is a short literal list per feature, exploded on the rows; the
    aggregation combines map-side, so nothing grows with the number of rows.
    """
    spec = model.spec
    probs = [low + (high - low) * i / (points - 1) for i in range(points)]
    grids = {r["column"]: sorted(set(r["q"])) for r in quantile_table(train, features, probs).collect()}
    fixed = [c for c in (spec.unit,) if c and c not in spec.columns]
    parts = []
    for f in features:
        rest = [c for c in spec.columns if c != f]
        rows = df.select(*fixed, *rest, F.explode(F.array(*[F.lit(float(v)) for v in grids[f]])).alias(f))
        parts.append(model.predict(rows).groupBy(F.lit(f).alias("feature"), F.col(f).alias("grid_value")).agg(
            F.avg("prediction").alias("mean"), F.stddev_samp("prediction").alias("std"), F.count("*").alias("n_rows")))
    return reduce(DataFrame.unionByName, parts)


def pca_variance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(component, variance_ratio, cumulative_ratio) of log1p(clip at zero), z-scored columns."""
    logged = complete_cases(df, cols).select(*[F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in cols])
    row = logged.agg(*[x for i, c in enumerate(cols) for x in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]).first()
    scaled = logged.select(*[((F.col(c) - row[f"m{i}"]) / (row[f"s{i}"] or 1.0)).alias(c) for i, c in enumerate(cols)])
    vectors = VectorAssembler(inputCols=list(cols), outputCol="v").transform(scaled)
    ratios = PCA(k=len(cols), inputCol="v", outputCol="p").fit(vectors).explainedVariance.toArray().tolist()
    rows, total = [], 0.0
    for i, r in enumerate(ratios):
        total += r
        rows.append((i + 1, float(r), float(total)))
    return df.sparkSession.createDataFrame(rows, "component int, variance_ratio double, cumulative_ratio double")


# ---- one-shot evaluation ---------------------------------------------------------------------

def evaluate_once(train: DataFrame, test: DataFrame, spec: Spec, params: Mapping[str, object], path: str, key: Sequence[str],
                  group: str) -> DataFrame:
    """Predict the locked holdout once; a second call verifies the stored rows instead of rewriting them."""
    from plumbline.functions.keys import table_digest
    from plumbline.operators.sets import assert_disjoint, assert_same_support
    from plumbline.sources.readers import path_exists
    spark = train.sparkSession
    predictions, lock = f"{path}/predictions", f"{path}/lock"
    have = (path_exists(spark, f"{predictions}/_SUCCESS"), path_exists(spark, f"{lock}/_SUCCESS"))
    inputs = table_digest(test.unionByName(train), [*key, spec.target, *spec.columns]).first()["digest"]
    if any(have):
        if not all(have):
            raise ValueError("a partial evaluation is stored; refusing to repair it")
        stored = spark.read.parquet(predictions)
        frozen = spark.read.parquet(lock).first()
        now = table_digest(stored).first()["digest"]
        if frozen["inputs"] != inputs or frozen["predictions"] != now or frozen["params"] != repr(sorted(params.items())):
            raise ValueError("stored evaluation does not match its lock")
        assert_same_support(stored, test, list(key))
        return stored
    assert_disjoint(train, test, group)
    model = fit(train, spec, params)
    model.predict(test).select(*key, group, F.col(spec.target).alias("y_true"), "prediction").write.parquet(predictions)
    stored = spark.read.parquet(predictions)
    row = [(inputs, table_digest(stored).first()["digest"], repr(sorted(params.items())))]
    spark.createDataFrame(row, "inputs string, predictions string, params string").coalesce(1).write.parquet(lock)
    return stored

