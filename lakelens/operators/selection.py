"""Principal components and feature selection as ML estimators on the ``all_features`` vector."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.operators import forests
from lakelens.operators.profile import report
from lakelens.plans.matrix import array_udf, as_array, gram, moments
from lakelens.plans.session import cut, forget

SEED = 123
METHODS = ("boruta", "lasso_cv", "l1_svm", None)


def principal_components(df: DataFrame, names: list[str], features: str = "features") -> dict[str, object]:
    """scores (rows plus ``pc`` array), loadings and explained tables, from one p x p aggregate.

    Signs are fixed so that the largest loading of every component is positive.
    """
    _, mean, cov = moments(gram(df, features)[""], ddof=1)
    val, vec = np.linalg.eigh(cov)
    order = np.argsort(-val)
    val, vec = np.maximum(val[order], 0.0), vec[:, order]
    vec = vec * np.sign(vec[np.abs(vec).argmax(axis=0), np.arange(vec.shape[1])])
    share = val / val.sum()
    pcs = [f"PC{i + 1}" for i in range(len(val))]
    spark = df.sparkSession
    scores = df.withColumn("pc", array_udf(lambda x: (x - mean) @ vec, "array<double>")(as_array(df, features)))
    loadings = [(n, c, vec[i, j]) for i, n in enumerate(names) for j, c in enumerate(pcs)]
    explained = [(c, j + 1, share[j], share[: j + 1].sum()) for j, c in enumerate(pcs)]
    return {
        "scores": scores,
        "loadings": report(spark, loadings, "feature string, component string, loading double"),
        "explained": report(spark, explained, "component string, position int, explained double, cumulative double"),
    }


class SelectedFeatures(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps chosen vector slots; at least one stays."""

    indices = Param(Params._dummy(), "indices", "kept slots", typeConverter=TypeConverters.toListInt)

    def _transform(self, df):
        return VectorSlicer(inputCol="all_features", outputCol="features", indices=self.getOrDefault(self.indices)).transform(df)


class _Selector(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    classification = Param(Params._dummy(), "classification", "classes or numbers", typeConverter=TypeConverters.toBoolean)

    def _is_class(self):
        return self.getOrDefault(self.classification)

    def _keep(self, weights, limit):
        kept = [int(i) for i in np.flatnonzero(np.asarray(weights) > limit)]
        return SelectedFeatures()._set(indices=kept or [int(np.argmax(weights))])


def _strength(model, classification):
    if classification:
        return np.abs(model.coefficientMatrix.toArray()).max(axis=0)
    return np.abs(model.coefficients.toArray())


class LassoCV(_Selector):
    """L1 path scored by 5-fold cross-validation; coefficients above 1e-5 stay."""

    def _fit(self, df):
        if self._is_class():
            est = LogisticRegression(featuresCol="all_features", elasticNetParam=1.0, maxIter=50)
            judge = MulticlassClassificationEvaluator(metricName="accuracy")
        else:
            est = LinearRegression(featuresCol="all_features", elasticNetParam=1.0, maxIter=50)
            judge = RegressionEvaluator(metricName="r2")
        grid = ParamGridBuilder().addGrid(est.regParam, [10.0**e for e in (-4, -3, -2, -1)]).build()
        best = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=judge, numFolds=5, seed=SEED, parallelism=4).fit(df).bestModel
        return self._keep(_strength(best, self._is_class()), 1e-5)


class MarginSelector(_Selector):
    """Sparse linear classifier at C = 1, or a robust linear fit with the mean-weight threshold."""

    def _fit(self, df):
        if self._is_class():
            model = LogisticRegression(featuresCol="all_features", elasticNetParam=1.0, regParam=1.0 / df.count(), maxIter=100).fit(df)
            return self._keep(_strength(model, True), 1e-5)
        w = _strength(LinearRegression(featuresCol="all_features", loss="huber", maxIter=100).fit(df), False)
        return self._keep(w, float(w.mean()) - 1e-15)


SHADOW_ROWS = 65_536  # rows, at least, over which a shadow is permuted, if there are as many for each core
FEW = 10_000  # and at least otherwise


def dealt(df: DataFrame, features: str) -> DataFrame:
    """(x, label) written once in a random order: dealt to tasks by a hash of the row and its number, and sorted by it there."""
    rows = df.select(as_array(df, features).alias("x"), F.col("label").cast("double").alias("label"))
    rows = cut(rows.withColumn("__i", F.monotonically_increasing_id()))  # written once, so the ids stay fixed
    n = rows.count()
    parts = max(1, min(df.sparkSession.sparkContext.defaultParallelism, n // FEW), min(4096, n // (2 * SHADOW_ROWS)))
    rows = rows.withColumn("__h", F.xxhash64("x", "label", "__i"))
    out = cut(rows.repartition(parts, "__h").sortWithinPartitions("__h").select("x", "label"))
    forget(rows)
    return out


def shadow_features(rows: DataFrame, seed: int, out: str) -> DataFrame:
    """(label, vector of originals and, per slot, the value of another row): a shadow without its relation to y.

    ``rows`` come from ``dealt``, so the rows that follow each other are a random sample. Every slot is permuted by itself
    over runs of SHADOW_ROWS of them (fewer in a smaller table, up to twice as many at the end of a task), so every shadow
    keeps the values of its column, and no row is shuffled or joined.
    """

    def permuted(x, y, rng):
        other = np.column_stack([rng.permutation(x[:, j]) for j in range(x.shape[1])])
        both = np.hstack([x, other])
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * both.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(y), pa.ListArray.from_arrays(offsets, pa.array(both.ravel()))], names=["label", "both"])

    def run(batches):
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        xs, ys, held = [], [], 0
        for batch in batches:
            if batch.num_rows:
                xs.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                ys.append(batch.column(1).to_numpy(zero_copy_only=False))
                held += batch.num_rows
            if held >= 2 * SHADOW_ROWS:
                x, y = np.concatenate(xs), np.concatenate(ys)
                yield permuted(x[:SHADOW_ROWS], y[:SHADOW_ROWS], rng)
                xs, ys, held = [x[SHADOW_ROWS:]], [y[SHADOW_ROWS:]], held - SHADOW_ROWS
        if held:
            yield permuted(np.concatenate(xs), np.concatenate(ys), rng)

    return rows.mapInArrow(run, "label double, both array<double>").select("label", array_to_vector("both").alias(out))


class Boruta(_Selector):
    """Random forests of depth 5 against shadow features; a binomial test on the hits confirms a slot."""

    rounds = Param(Params._dummy(), "rounds", "number of forests", typeConverter=TypeConverters.toInt)

    def _fit(self, df):
        rounds = self.getOrDefault(self.rounds) if self.isDefined(self.rounds) else 20
        hits, rows = None, dealt(df, "all_features")
        classes = int(rows.agg(F.max("label")).first()[0]) + 1 if self._is_class() else 0
        edges = 2 * forests.bin_edges(rows, "x", 32, seed=SEED)  # a shadow has the values of its slot
        for r in range(rounds):
            data = shadow_features(rows, SEED + r, "__both")
            imp = forests.fit(data, "__both", "label", trees=50, depth=5, classes=classes, edges=edges, seed=SEED + r).importances()
            p = len(imp) // 2
            won = imp[:p] > imp[p:].max()
            hits = won.astype(int) if hits is None else hits + won
        forget(rows)
        tail = [sum(math.comb(rounds, j) for j in range(int(h), rounds + 1)) / 2**rounds for h in hits]
        kept = [i for i, t in enumerate(tail) if t * len(hits) < 0.05]
        return SelectedFeatures()._set(indices=kept or [int(np.argmax(hits))])


def selector(method: str | None, operation: str):
    """Estimator of a selection method, or None."""
    assert method in METHODS, f"feature selection must be one of {METHODS}"
    made = {"boruta": Boruta, "lasso_cv": LassoCV, "l1_svm": MarginSelector, None: None}[method]
    return made()._set(classification=operation == "classification") if made else None


def dropping_curve(df: DataFrame, spec, operation: str, id_columns: list[str], fractions=(0.1, 0.325, 0.55, 0.775, 1.0), folds: int = 5) -> DataFrame:
    """(fraction, n_features, fold, score): cross-validated score on random feature subsets."""
    from lakelens.operators import metrics
    from lakelens.operators.cv import _main_metric
    from lakelens.operators.split import fold_parts, k_folds

    p = df.first()["features"].size
    order = np.random.default_rng(SEED).permutation(p)
    base, rows = cut(k_folds(df, id_columns, folds)), []
    for f in fractions:
        keep = sorted(int(i) for i in order[: max(1, round(f * p))])
        part = VectorSlicer(inputCol="features", outputCol="__s", indices=keep).transform(base).drop("features").withColumnRenamed("__s", "features")
        for fold in range(folds):
            train, val = fold_parts(part, "fold", fold)
            s = metrics.scores(spec.build().fit(train).transform(val), "label", "prediction", operation).first()[_main_metric(operation)]
            rows.append((f, len(keep), fold, s))
    return report(df.sparkSession, rows, "fraction double, n_features int, fold int, score double")
