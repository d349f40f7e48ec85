"""Forests grown by levels: the trees are those of Spark's learners, whatever the parts of the table."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from lakelens.operators import forests


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    n = 3000
    a, b, c = rng.integers(0, 20, n).astype(float), rng.integers(0, 9, n).astype(float), rng.integers(0, 5, n)
    y = 3 * a - 2 * b * (a > 8) + np.array([0.0, 9.0, -4.0, 2.0, 30.0])[c] + rng.normal(0, 0.5, n)
    k = np.digitize(y + 5 * (c == 2), [10.0, 35.0])
    df = spark.createDataFrame([(float(u), float(v), "vwxyz"[w], float(s), float(t)) for u, v, w, s, t in zip(a, b, c, y, k)], "a double, b double, c string, y double, k double")
    df = StringIndexer(inputCol="c", outputCol="ic", handleInvalid="keep", stringOrderType="alphabetAsc").fit(df).transform(df)
    return VectorAssembler(inputCols=["a", "b", "ic"], outputCol="x").transform(df).repartition(3).persist()


@pytest.mark.parametrize("label", ["y", "k"])
def test_a_tree_is_that_of_spark(table, label, monkeypatch):
    monkeypatch.setattr(forests, "RUN", 500)
    monkeypatch.setattr(forests, "OWNED", 100)  # nodes of a level go to several tasks
    monkeypatch.setattr(forests, "DIRECT", 0)
    got = forests.fit(table, "x", label, trees=1, depth=5, bins=64, classes=3 if label == "k" else 0, bootstrap=False)
    made = DecisionTreeClassifier if label == "k" else DecisionTreeRegressor
    want = made(featuresCol="x", labelCol=label, maxDepth=5, maxBins=64).fit(table)
    out = forests.GrownForest.of(got, featuresCol="x", predictionCol="p", probabilityCol="q").transform(want.transform(table)).toPandas()
    if label == "k":
        assert (out["p"] == out["prediction"]).mean() > 0.995
        assert np.abs(np.stack([v.toArray() for v in out["q"]]) - np.stack([v.toArray() for v in out["probability"]])).mean() < 0.01
    else:
        assert np.allclose(out["p"], out["prediction"])
    assert np.allclose(got.importances(), want.featureImportances.toArray(), atol=1e-9 if label == "y" else 0.01)


@pytest.mark.parametrize("label", ["y", "k"])
def test_a_forest_is_like_that_of_spark(table, label, tmp_path):
    classes = 3 if label == "k" else 0
    got = forests.fit(table, "x", label, trees=50, depth=5, classes=classes, rate=0.63, seed=2)
    want = (RandomForestClassifier if classes else RandomForestRegressor)(featuresCol="x", labelCol=label, maxDepth=5, numTrees=50, subsamplingRate=0.63, seed=2).fit(table)
    assert np.abs(got.importances() - want.featureImportances.toArray()).max() < 0.1
    model = forests.GrownForest.of(got, featuresCol="x", predictionCol="p", probabilityCol="q")
    model.write().save(f"{tmp_path}/m")
    out = forests.GrownForest.load(f"{tmp_path}/m").transform(want.transform(table))
    wrong = lambda c: out.agg(F.avg((F.col(c) != F.col(label)).cast("int") if classes else F.abs(F.col(c) - F.col(label)))).first()[0]
    assert wrong("p") < wrong("prediction") * 1.2 + 0.01
    if classes:
        assert out.where(F.abs(F.aggregate(vector_to_array("q"), F.lit(0.0), lambda s, v: s + v) - 1) > 1e-9).isEmpty()


def test_passes_bags_and_odd_rows(spark, table, monkeypatch):
    whole = forests.fit(table, "x", "y", trees=6, depth=4, seed=1)
    monkeypatch.setattr(forests, "HELD", 100)  # one tree in a pass
    again = forests.fit(table, "x", "y", trees=6, depth=4, seed=1)
    assert np.array_equal(whole.slot, again.slot) and np.allclose(whole.value, again.value)
    assert len({t.tobytes() for t in whole.slot}) > 1  # bags and slots differ by tree
    one = spark.createDataFrame([([1.0, float("nan")], 4.0)] * 3, "v array<double>, y double").select(array_to_vector("v").alias("x"), "y")
    got = forests.fit(one, "x", "y", trees=2, depth=3, bootstrap=False)
    assert got.predict(np.array([[1.0, np.nan], [7.0, 0.0]])).tolist() == [[4.0], [4.0]] and got.importances().tolist() == [0.0, 0.0]
    assert forests._poisson(0.63).mean() == pytest.approx(0.63, abs=1e-3)
