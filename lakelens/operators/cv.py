"""Model selection: cross-validation, nested cross-validation, random search, test scores."""

from __future__ import annotations

import math
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.functions.columns import col, infer_operation, roles
from lakelens.operators import metrics
from lakelens.operators.models import SEED, Spec, classifiers, regressors
from lakelens.operators.prep import Levels, data_preprocessing
from lakelens.operators.profile import report
from lakelens.operators.reshape import add_run_keys, drop_missing_target, drop_time_columns, stack_results, written_once
from lakelens.operators.split import repeated_folds, train_test_split
from lakelens.plans.session import cut


def metric_names(operation: str) -> tuple[str, ...]:
    return metrics.REGRESSION if operation == "regression" else metrics.CLASSIFICATION


def _main_metric(operation: str) -> str:
    return "R2" if operation == "regression" else "F1"


def prepare_target(df: DataFrame, target: str) -> tuple[DataFrame, str, object]:
    """Drop time columns, rows without target and duplicates; add ``label`` (codes of sorted classes).

    The rows left are written: strata, sizes and the split each read them, and would each compare all rows again.
    """
    df = written_once(drop_missing_target(drop_time_columns(df), target))
    operation = infer_operation(df, target)
    if operation == "regression":
        return df.withColumn("label", col(target).cast("double")), operation, None
    levels = Levels(inputCols=[target]).fit(df)
    coded = levels.transform(df)
    return coded.withColumn("label", col(f"{target}_code").cast("double")).drop(f"{target}_code"), operation, levels


def model_specs(names: list[str], operation: str, n_rows: int, n_cols: int, n_classes: int) -> list[Spec]:
    all_specs = regressors(n_rows, n_cols) if operation == "regression" else classifiers(n_rows, n_cols, n_classes == 2, n_classes)
    unknown = [n for n in names if n not in all_specs]
    assert not unknown, f"unknown models {unknown}; choose from {sorted(all_specs)}"
    return [all_specs[n] for n in names]


class CrossValidation:
    """Fold-wise fits over fold columns; every (fit, score) is a Spark job from a small thread pool."""

    def __init__(self, df: DataFrame, body: list[str], operation: str, folds: int, repeats: int, preparation: dict, inside: bool, average: str, parallelism: int, selector=None):
        self.df, self.body, self.operation, self.average = df, body, operation, average
        self.folds, self.repeats, self.parallelism = folds, repeats, parallelism
        self.preparation, self.inside, self.selector = preparation, inside, selector
        self._parts: dict = {}

    def part(self, rep: int, fold: int) -> tuple[DataFrame, DataFrame]:
        if (rep, fold) not in self._parts:
            c = F.col(f"fold_{rep}")
            train, val = self.df.where(c != fold), self.df.where(c == fold)
            if self.inside:
                model = fit_preparation(train, self.body, self.preparation, self.selector)
                train, val = transform_rows(model, train), transform_rows(model, val)
            self._parts[rep, fold] = (train.select("features", "label").persist(), val.select("features", "label").persist())
        return self._parts[rep, fold]

    def run(self, spec: Spec, params: dict | None = None) -> DataFrame:
        """(rep, fold, time, scores) of one model."""
        names = metric_names(self.operation)
        jobs = [(r, f) for r in range(1, self.repeats + 1) for f in range(self.folds)]
        for job in jobs:
            self.part(*job)

        def one(job):
            train, val = self.part(*job)
            start = time.time()
            model = spec.build(**(params or {})).fit(train)
            s = metrics.scores(model.transform(val), "label", "prediction", self.operation, self.average).first()
            return (*job, time.time() - start, *[s[m] for m in names])

        with ThreadPoolExecutor(self.parallelism) as pool:
            rows = list(pool.map(one, jobs))
        return report(self.df.sparkSession, rows, "rep int, fold int, time double, " + ", ".join(f"{m} double" for m in names))

    def close(self):
        for pair in self._parts.values():
            for p in pair:
                p.unpersist()
        self._parts.clear()


def fit_preparation(train: DataFrame, body: list[str], preparation: dict, selector=None) -> PipelineModel:
    """Preparation (and optional feature selection) fitted on the training rows only."""
    stages = [data_preprocessing(train.select(body), **preparation).fit(train.select(body))]
    if selector is not None:
        stages.append(selector.fit(transform_rows(stages[0], train).withColumnRenamed("features", "all_features")))
    return PipelineModel(stages)


def transform_rows(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = rows
    for i, stage in enumerate(model.stages):
        out = stage.transform(out)
        if i + 1 < len(model.stages):
            out = out.withColumnRenamed("features", "all_features")
    return out


def draw(spec: Spec, rng: np.random.Generator) -> dict:
    """One random point: log-uniform where the range spans three decades or more."""
    out = {}
    for k, r in spec.space.items():
        if isinstance(r, list):
            out[k] = r[int(rng.integers(len(r)))]
        else:
            lo, hi = r
            v = math.exp(rng.uniform(math.log(lo), math.log(hi))) if lo > 0 and hi / lo >= 1000 else rng.uniform(lo, hi)
            out[k] = int(round(v)) if k in spec.integer else float(v)
    return out


TRIALS = "model string, trial int, value double, params map<string,string>, duration double"


def random_search(cv: CrossValidation, spec: Spec, trials: int, metric: str, seed: int = SEED) -> tuple[dict, DataFrame]:
    """Best parameters and the trial table; models without parameters are not searched."""
    spark = cv.df.sparkSession
    if not spec.space or trials == 0:
        return {}, report(spark, [], TRIALS)
    rng, rows, best = np.random.default_rng(seed), [], None
    sign = -1 if metric in ("MAE", "MSE", "RMSE", "RMSLE", "MAPE") else 1
    for t in range(trials):
        params, start = draw(spec, rng), time.time()
        value = cv.run(spec, params).agg(F.avg(metric)).first()[0]
        rows.append((spec.name, t, value, {k: str(v) for k, v in params.items()}, time.time() - start))
        if value is not None and (best is None or sign * value > sign * best[0]):
            best = (value, params)
    return (best[1] if best else {}), report(spark, rows, TRIALS)


class Result(dict):
    """cv, test and trials tables; fitted models under ``models``."""


def run(
    df: DataFrame,
    target: str,
    id_columns: list[str],
    models: list[str],
    train_size: float = 0.8,
    folds: int = 10,
    repeats: int = 5,
    trials: int = 0,
    preparation: dict | None = None,
    feature_selection: str | None = None,
    prepare_inside_folds: bool = True,
    average: str = "macro",
    metric: str | None = None,
    parallelism: int = 4,
) -> Result:
    """Whole model selection: split, cross-validation, optional search, final fit, test scores."""
    from lakelens.operators.selection import selector

    work, operation, levels = prepare_target(df, target)
    split = cut(train_test_split(work, target, id_columns, train_size))
    train, test = split.where("is_train").drop("is_train"), split.where("NOT is_train").drop("is_train")
    return _select(train, test, target, id_columns, models, operation, levels, folds, repeats, trials, preparation or {}, selector(feature_selection, operation), prepare_inside_folds, average, metric, parallelism)


def _select(train, test, target, id_columns, models, operation, levels, folds, repeats, trials, preparation, sel, inside, average, metric, parallelism) -> Result:
    spark = train.sparkSession
    body = [c for c in train.columns if c not in {*id_columns, target, "label"} and c in set(roles(train).num + roles(train).cat)]
    folded = cut(repeated_folds(train, id_columns, folds, repeats, target=target))
    whole = fit_preparation(train, body, preparation, sel)
    ready = cut(transform_rows(whole, train).select("features", "label"))
    ready_test = cut(transform_rows(whole, test).select("features", "label"))
    n_rows = int(ready.count() * (folds - 1) / folds)
    n_cols = ready.first()["features"].size
    n_classes = 0 if operation == "regression" else ready.select("label").distinct().count()
    base = folded
    if not inside:
        base = transform_rows(whole, folded)
    cv = CrossValidation(base, body, operation, folds, repeats, preparation, inside, average, parallelism, sel)
    names = metric_names(operation)
    metric = metric or _main_metric(operation)
    cv_tables, test_rows, trial_tables, fitted = [], [], [], {}
    for spec in model_specs(models, operation, n_rows, n_cols, n_classes):
        params, history = random_search(cv, spec, trials, metric)
        name = f"{spec.name}_{'tuned' if trials else 'baseline'}"
        cv_tables.append(cv.run(spec, params).withColumn("model", F.lit(name)))
        trial_tables.append(history)
        model = spec.build(**params).fit(ready)
        s = metrics.scores(model.transform(ready_test), "label", "prediction", operation, average).first()
        test_rows.append((name, *[s[m] for m in names]))
        fitted[name] = model
    cv.close()
    return Result(
        cv=stack_results(cv_tables).select("model", "rep", "fold", "time", *names),
        test=report(spark, test_rows, "model string, " + ", ".join(f"{m} double" for m in names)),
        trials=stack_results(trial_tables),
        models=fitted,
        preparation=whole,
        levels=levels,
        test_rows=ready_test,
        train_rows=ready,
        operation=operation,
    )


def run_nested(df: DataFrame, target: str, id_columns: list[str], models: list[str], outer: tuple[int, int] = (10, 5), inner: tuple[int, int] = (10, 5), trials: int = 0, preparation: dict | None = None, **kw) -> Result:
    """Nested cross-validation: every outer fold runs the whole inner selection; rows carry rep and fold."""
    from lakelens.operators.selection import selector

    work, operation, levels = prepare_target(df, target)
    folds, repeats = outer
    folded = cut(repeated_folds(work, id_columns, folds, repeats, target=target))
    plain = [c for c in folded.columns if not c.startswith("fold_")]
    cvs, tests, trial_tables = [], [], []
    for i in range(folds * repeats):
        rep, fold = i // folds + 1, i % folds
        c = F.col(f"fold_{rep}")
        got = _select(
            folded.where(c != fold).select(plain), folded.where(c == fold).select(plain), target, id_columns, models, operation, levels, inner[0], inner[1], trials,
            preparation or {}, selector(kw.get("feature_selection"), operation), kw.get("prepare_inside_folds", True), kw.get("average", "macro"), kw.get("metric"), kw.get("parallelism", 4),
        )
        cvs.append(add_run_keys(got["cv"].withColumnsRenamed({"rep": "inner_rep", "fold": "inner_fold"}), i + 1, folds))
        tests.append(add_run_keys(got["test"], i + 1, folds))
        trial_tables.append(add_run_keys(got["trials"], i + 1, folds))
    return Result(cv=stack_results(cvs), test=stack_results(tests), trials=stack_results(trial_tables), operation=operation, levels=levels)


def learning_curve(df: DataFrame, spec: Spec, operation: str, id_columns: list[str], fractions=(0.1, 0.325, 0.55, 0.775, 1.0), folds: int = 5, average: str = "macro", metric: str | None = None) -> DataFrame:
    """(fraction, fold, train_score, cv_score) of prepared rows (features, label)."""
    from lakelens.operators.split import fold_parts, k_folds, learning_subsets

    metric = metric or _main_metric(operation)
    base, rows = cut(k_folds(df, id_columns, folds)), []
    for fold in range(folds):
        train, val = fold_parts(base, "fold", fold)
        for f, part in zip(fractions, learning_subsets(train, id_columns, list(fractions))):
            model = spec.build().fit(part)
            a, b = (metrics.scores(model.transform(x), "label", "prediction", operation, average).first()[metric] for x in (part, val))
            rows.append((f, fold, a, b))
    return report(df.sparkSession, rows, "fraction double, fold int, train_score double, cv_score double")
