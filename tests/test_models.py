"""Preparation, splits, models, explanations, series and streams."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from lakelens.operators import cv, explain, metrics, models, prep, selection, series, split
from lakelens.operators.impute import ForestImputer
from lakelens.plans.session import checkpoint_root
from lakelens.registry import series_queries as sq
from lakelens.sources.io import load_pipeline, save_pipeline, table


def linear_data(spark, n=600, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[:, 2] += 0.5 * x[:, 0]
    y = 3 * x[:, 0] - 2 * x[:, 1] + 0.5 + rng.normal(0, 0.1, n)
    df = spark.createDataFrame([(i, [float(a) for a in v], float(b)) for i, (v, b) in enumerate(zip(x, y))], "id long, v array<double>, label double")
    return df.select("id", array_to_vector("v").alias("features"), "label").repartition(4).persist(), x, y


def test_preparation_round_trip_and_unknown_values(spark):
    train = spark.createDataFrame([(1.0, "a", "y"), (3.0, "b", "n"), (None, "a", None), (float("nan"), "c", "y")] * 10, "x double, c string, b string")
    m = prep.data_preprocessing(train).fit(train)
    path = f"{checkpoint_root(spark)}/prep"
    save_pipeline(m, path)
    again = load_pipeline(path)
    new = spark.createDataFrame([(2.0, "unseen", "y"), (None, None, None)], "x double, c string, b string")
    a, b = (t.transform(new).select(vector_to_array("features").alias("v")).collect() for t in (m, again))
    assert a == b
    assert prep.feature_names(again.transform(new)) == ["x", "c_a", "c_b", "c_c", "b_y"]
    assert list(a[0]["v"]) == [0.0, 0.0, 0.0, 0.0, 1.0] and list(a[1]["v"]) == [0.0, 1.0, 0.0, 0.0, 1.0]
    with pytest.raises(AssertionError):
        prep.data_preprocessing(train, scaler="nope")


def test_yeo_johnson_is_the_likelihood_maximum(spark):
    rng = np.random.default_rng(0)
    x = rng.lognormal(size=400)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    lam = prep.yeo_johnson_lambdas(df, ["x"])["x"]

    def ll(k):
        t = np.log1p(x) if abs(k) < 1e-12 else ((x + 1) ** k - 1) / k
        return -0.5 * len(x) * math.log(t.var()) + (k - 1) * np.log1p(x).sum()

    assert ll(lam) >= max(ll(lam - 1e-3), ll(lam + 1e-3)) - 1e-9


def test_folds_partition_rows_and_keep_shares(spark, folder):
    o = table(spark, folder, "orders")
    f = split.k_folds(o, ["o_orderkey"], 5, target="o_orderstatus")
    per = f.groupBy("o_orderstatus", "fold").count().toPandas()
    assert per["count"].sum() == o.count()
    spread = per.groupby("o_orderstatus")["count"].agg(lambda c: c.max() - c.min())
    assert spread.max() <= 1
    again = split.k_folds(o.repartition(7), ["o_orderkey"], 5, target="o_orderstatus")
    assert f.select("o_orderkey", "fold").exceptAll(again.select("o_orderkey", "fold")).isEmpty()
    w = split.bootstrap_weights(o, ["o_orderkey"], 1).agg(F.avg("weight"), F.var_pop("weight")).first()
    assert abs(w[0] - 1) < 0.1 and abs(w[1] - 1) < 0.2


def test_linear_models_match_normal_equations(spark):
    df, x, y = linear_data(spark)
    z = np.hstack([np.ones((len(x), 1)), x])
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    for name, tol in (("Linear_Regression", 1e-6), ("Bayesian_Ridge", 1e-2)):
        m = models.regressors(len(x), 3)[name].build().fit(df)
        p = {r["id"]: r["prediction"] for r in m.transform(df).select("id", "prediction").collect()}
        assert max(abs(p[i] - z[i] @ b) for i in p) < tol


def test_classifiers_beat_the_constant_model(spark):
    df, x, y = linear_data(spark)
    data = df.withColumn("label", (F.col("label") > 0.5).cast("double"))
    base = max(float((y > 0.5).mean()), float((y <= 0.5).mean()))
    specs = models.classifiers(len(x), 3, True, 2)
    for name in ("GaussianNaiveBayes", "LogisticRegression", "LDA", "SVM_L", "SVM_R", "KNN", "DecisionTree"):
        s = metrics.classification_scores(specs[name].build().fit(data).transform(data), "label", "prediction").first()
        assert s["Accuracy"] > base + 0.2, name


def test_model_selection_tables(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_nationkey", F.when(F.col("c_acctbal") > 4500, "rich").otherwise("poor").alias("level"))
    got = cv.run(c, "level", ["c_custkey"], ["LDA", "DecisionTree"], folds=2, repeats=2, trials=2)
    assert got["cv"].groupBy("model").count().collect()[0]["count"] == 4
    assert {r["model"] for r in got["test"].collect()} == {"LDA_tuned", "DecisionTree_tuned"}
    assert got["trials"].count() == 2  # LDA has nothing to search
    with pytest.raises(AssertionError):
        cv.model_specs(["nope"], "regression", 10, 2, 0)


def test_pca_matches_numpy(spark):
    df, x, _ = linear_data(spark)
    got = selection.principal_components(df, ["a", "b", "c"])
    val = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert [r["explained"] for r in got["explained"].orderBy("position").collect()] == pytest.approx(list(val / val.sum()))


@pytest.mark.parametrize("method", ["lasso_cv", "l1_svm", "boruta"])
def test_selection_drops_noise(spark, method):
    df, x, _ = linear_data(spark)
    wide = df.withColumn("all_features", df["features"])
    est = selection.selector(method, "regression")
    if method == "boruta":
        est._set(rounds=8)
    kept = est.fit(wide.select("all_features", "label")).getOrDefault("indices")
    assert {0, 1} <= set(kept)


def test_forest_imputer_fills_everything(spark):
    rows = [(float(i % 10), None if i % 7 == 0 else float(2 * (i % 10)), None if i % 5 == 0 else ("lo" if i % 10 < 5 else "hi")) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c string")
    for method in ("miss_forest", "mice_forest"):
        out = ForestImputer(nums=["a", "b"], cats=["c"], method=method, rounds=2).fit(df).transform(df)
        assert out.where("b IS NULL OR c IS NULL").count() == 0
        err = out.agg(F.avg(F.abs(F.col("b") - 2 * F.col("a")))).first()[0]
        assert err < 1.0


@pytest.mark.parametrize("make", [lambda: RandomForestRegressor(numTrees=4, maxDepth=3, seed=1), lambda: GBTRegressor(maxIter=3, maxDepth=2, seed=1)])
def test_tree_attributions_add_up(spark, make):
    df, _, _ = linear_data(spark)
    m = make().fit(df)
    phi, base = explain.tree_shap(m, df, "id", ["a", "b", "c"])
    total = {r["id"]: r["s"] for r in phi.groupBy("id").agg(F.sum("shap").alias("s")).collect()}
    pred = {r["id"]: r["prediction"] for r in m.transform(df).select("id", "prediction").collect()}
    assert max(abs(total[i] + base - pred[i]) for i in pred) < 1e-9


def test_tree_attributions_of_classifiers_and_categories(spark):
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler, VectorIndexer

    rows = [(i, float(i % 5), float((i * 7) % 11), float(i % 5 in (1, 4)) if (i * 7) % 11 < 8 else float(i % 2)) for i in range(400)]
    raw = VectorAssembler(inputCols=["a", "b"], outputCol="raw").transform(spark.createDataFrame(rows, "id long, a double, b double, label double"))
    df = VectorIndexer(inputCol="raw", outputCol="features", maxCategories=6).fit(raw).transform(raw).select("id", "features", "label")
    for model, wanted in (
        (GBTClassifier(maxIter=4, maxDepth=3, seed=1).fit(df), lambda r: r["rawPrediction"][1]),
        (RandomForestClassifier(numTrees=4, maxDepth=4, seed=1).fit(df), lambda r: r["probability"][1]),
        (RandomForestRegressor(numTrees=4, maxDepth=4, seed=1).fit(df), lambda r: r["prediction"]),
    ):
        phi, base = explain.tree_shap(model, df, "id", ["a", "b"], classification="Classif" in type(model).__name__, target=1)
        total = {r["id"]: r["s"] for r in phi.groupBy("id").agg(F.sum("shap").alias("s")).collect()}
        assert all(abs(total[r["id"]] + base - wanted(r)) < 1e-9 for r in model.transform(df).collect())


def test_forest_imputation_of_many_categories(spark):
    df = spark.range(700).select((F.col("id") % 70).cast("double").alias("a"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("k"), F.col("id") % 70)).alias("c"))
    out = ForestImputer(nums=["a"], cats=["c"], method="miss_forest", rounds=2).fit(df).transform(df)
    assert out.where("c IS NULL").isEmpty()


def test_margins_become_probabilities(spark):
    raw = [[-1.5, 1.5], [2.0, -2.0], [0.3, -700.0, 700.0]]
    df = spark.createDataFrame([(v,) for v in raw], "v array<double>").select(array_to_vector("v").alias("rawPrediction"))
    for r in models.MarginProbability().transform(df).collect():
        want = np.exp(np.array(r["rawPrediction"]) - max(r["rawPrediction"]))
        assert np.allclose(r["probability"], want / want.sum())
    rows = [([float(i % 2) + 0.1 * (i % 7)], float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "v array<double>, label double").select(array_to_vector("v").alias("features"), "label").coalesce(1).persist()
    out = models.classifiers(60, 1, True, 2)["SVM_L"].build().fit(df).transform(df).select("prediction", vector_to_array("probability").alias("p")).collect()
    assert all(r["p"][int(r["prediction"])] == max(r["p"]) for r in out)


def test_permutation_attributions_of_a_linear_model(spark):
    df, x, y = linear_data(spark)
    m = LinearRegression().fit(df)
    some, bg = df.where("id < 10"), df.where("id >= 500")
    phi = {(r["id"], r["feature"]): r["shap"] for r in explain.permutation_shap(m, some, "id", ["a", "b", "c"], bg, permutations=1).collect()}
    w, mean = m.coefficients.toArray(), x[500:].mean(axis=0)
    for i in range(10):
        for j, name in enumerate("abc"):
            assert phi[i, name] == pytest.approx(w[j] * (x[i, j] - mean[j]), abs=1e-9)


def test_partial_dependence_of_a_linear_model(spark):
    df, x, _ = linear_data(spark)
    m = LinearRegression().fit(df)
    got = {r["grid"]: r["average"] for r in explain.partial_dependence(m, df, ["a", "b", "c"], ["b"], points=5).collect()}
    w = m.coefficients.toArray()
    other = m.intercept + w[0] * x[:, 0].mean() + w[2] * x[:, 2].mean()
    assert all(v == pytest.approx(other + w[1] * g) for g, v in got.items()) and len(got) == 5


def test_treatment_effects_recover_coefficients(spark):
    df, _, _ = linear_data(spark)
    folded = split.k_folds(df, ["id"], 5)
    got = {r["feature"]: r for r in explain.average_treatment_effects(folded, ["a", "b", "c"], "fold").collect()}
    assert got["a"]["ate"] == pytest.approx(3, abs=0.05) and got["b"]["ate"] == pytest.approx(-2, abs=0.05)
    assert got["a"]["p_value"] < 1e-6 and got["c"]["p_value"] > 1e-3
    own = explain.average_treatment_effects(folded, ["a", "b", "c"], "fold", outcome_model=LinearRegression())
    assert {r["feature"]: r["ate"] for r in own.collect()} == pytest.approx({k: v["ate"] for k, v in got.items()}, abs=1e-6)


def walk(spark, kind, n=300):
    rng = np.random.default_rng(5)
    e = rng.normal(size=n)
    x = np.cumsum(e) if kind == "walk" else e
    rows = [(f"2024-01-01T00:00:00", i, float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "t string, i int, x double").select(F.expr("timestamp'2024-01-01' + make_interval(0,0,0,0,i)").alias("ts"), "x"), x


@pytest.mark.parametrize("kind", ["walk", "noise"])
def test_stationarity_tests_by_direct_formula(spark, kind):
    df, x = walk(spark, kind)
    n = len(x)
    k, a = series.kpss(df, "ts", "x", block=60).first(), series.adf(df, "ts", "x", block=60).first()
    e = x - x.mean()
    lr = (e @ e + 2 * sum(e[j:] @ e[:-j] * (1 - j / (k["lags"] + 1)) for j in range(1, k["lags"] + 1))) / n
    assert k["statistic"] == pytest.approx((np.cumsum(e) ** 2).sum() / n**2 / lr)
    d, m = np.diff(x), a["lags"]
    z = np.column_stack([np.ones(n - 1 - m), x[m:-1], *[d[m - j : len(d) - j] for j in range(1, m + 1)]])
    b, rss = np.linalg.lstsq(z, d[m:], rcond=None)[:2]
    se = math.sqrt(rss[0] / (len(z) - z.shape[1]) * np.linalg.inv(z.T @ z)[1, 1])
    assert a["statistic"] == pytest.approx(b[1] / se)
    assert (a["p_value"] > 0.05) == (kind == "walk") and (k["p_value"] <= 0.05) == (kind == "walk")


def test_stream_scores_equal_batch_scores(spark, folder):
    qs = {"b": "z1_batch_scoring", "s": "z2_stream_scoring"}
    from __spark_entry__ import queries

    batch, stream = (queries()[q](spark, folder) for q in qs.values())
    assert batch.count() == stream.count() and batch.exceptAll(stream).isEmpty()
    with pytest.raises(ValueError):
        sq.serve.check_input(spark.range(1), ["value"], [])


def test_permutation_shap_query_covers_every_test_row(spark, folder):
    from lakelens.registry import load
    from lakelens.registry import model_queries as mq

    m, test, names = mq.forest_model(spark, folder)
    got = load()[0]["xp2_permutation_shap"](spark, folder)
    per = got.groupBy("row_id").agg(F.count("*").alias("n"), F.sum("shap").alias("s"))
    n = test.count()
    assert n > 100
    f = mq._with_id(m.transform(test)).select("row_id", "prediction").join(per, "row_id").toPandas()
    assert len(f) == n and set(f["n"]) == {len(names)}
    gap = f["prediction"] - f["s"]  # the mean prediction of the background, the same for every row
    assert gap.max() - gap.min() < 1e-6 * abs(gap.mean())


@pytest.mark.parametrize("kind", ["forest", "boosted", "classes"])
def test_permutation_attributions_of_trees_need_no_coalition_rows(spark, monkeypatch, kind):
    from pyspark.ml.classification import RandomForestClassifier

    df, _, _ = linear_data(spark)
    if kind == "classes":
        m, target = RandomForestClassifier(numTrees=4, maxDepth=3, seed=1).fit(df.withColumn("label", (F.col("label") > 0).cast("double"))), 1
    else:
        m, target = (RandomForestRegressor(numTrees=4, maxDepth=4, seed=1) if kind == "forest" else GBTRegressor(maxIter=3, maxDepth=3, seed=1)).fit(df), None
    some, bg = df.where("id < 6").unionByName(df.where("id = 2")), df.where("id >= 500")
    names = ["a", "b", "c"]
    args = (m, some, "id", names, bg, target, 2)
    got = explain.permutation_shap(*args)
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()  # no row by coalition and background row
    found = {(r["id"], r["feature"]): r["shap"] for r in got.collect()}
    monkeypatch.setattr(explain, "_is_tree_sum", lambda *a: False)
    plain = {(r["id"], r["feature"]): r["shap"] for r in explain.permutation_shap(*args).collect()}
    assert found.keys() == plain.keys() and len(found) == 18
    assert all(found[k] == pytest.approx(plain[k], abs=1e-9) for k in plain)


@pytest.mark.parametrize("task", ["binary", "regression"])
def test_rbf_machine_agrees_with_the_linear_learners_and_stores_no_fourier_features(spark, task):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 2))
    y = np.sin(2 * x[:, 0]) + x[:, 1] ** 2 + rng.normal(0, 0.1, len(x))
    y = (y > 0.8).astype(float) if task == "binary" else y
    df = spark.createDataFrame([([float(a) for a in v], float(b)) for v, b in zip(x, y)], "v array<double>, label double").select(array_to_vector("v").alias("features"), "label").repartition(3).persist()
    specs = models.classifiers(len(x), 2, True, 2) if task == "binary" else models.regressors(len(x), 2)
    lifted = []
    real = models._blocks
    models._blocks = lambda rows, most: lifted.append(rows.columns) or real(rows, most)
    try:
        got = specs["SVM_R"].build(gamma=0.3).fit(df)
    finally:
        models._blocks = real
    assert lifted == [["x", "y"]]  # the former learners kept 200 numbers for each row
    wide = models.FourierFeatures(gamma=0.3).transform(df)
    if task == "binary":
        old = LinearSVC(regParam=1 / len(x), featuresCol="fourier", maxIter=100).fit(wide)
    else:
        old = LinearRegression(loss="huber", epsilon=1.35, regParam=1 / len(x), featuresCol="fourier").fit(wide)
    w, b = models._waves(2, 200, 0.3)
    z = np.sqrt(2 / 200) * np.cos(x @ w + b)

    def objective(coefficients, constant):
        f = z @ coefficients + constant
        penalty = 0.5 / len(x) * ((coefficients * z.std(0, ddof=1)) ** 2).sum()
        if task == "binary":
            return np.maximum(0, 1 - (2 * y - 1) * f).mean() + penalty
        r = np.abs(y - f)
        return penalty + min(0.5 * np.where(r <= 1.35 * s, s + r * r / s, s + 2.7 * r - 1.35**2 * s).mean() for s in np.geomspace(0.01, 2, 400))

    mine = np.array(got.stages[1].getOrDefault("fitted")["weights"][0])
    before = objective(old.coefficients.toArray(), old.intercept)
    assert objective(mine[:-1] / np.sqrt(2 / 200), mine[-1]) <= before * 1.01
    out = got.transform(df).select("prediction", "label").toPandas()
    error = float((out["prediction"] != out["label"]).mean()) if task == "binary" else float(((out["prediction"] - out["label"]) ** 2).mean())
    assert error < 0.1


def test_rbf_machine_of_three_classes(spark, monkeypatch):
    monkeypatch.setattr(models.RbfMachine, "BANDS", (2.0,))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    y = np.digitize((x**2).sum(1), [0.8, 2.5]).astype(float)
    df = spark.createDataFrame([([float(a) for a in v], float(b)) for v, b in zip(x, y)], "v array<double>, label double").select(array_to_vector("v").alias("features"), "label")
    m = models.classifiers(len(x), 2, False, 3)["SVM_R"].build(gamma=0.5).fit(df)
    assert len(m.stages[1].getOrDefault("fitted")["weights"]) == 3
    path = f"{checkpoint_root(spark)}/rbf"
    m.write().overwrite().save(path)
    out = PipelineModel.load(path).transform(df).select("label", "prediction", vector_to_array("probability").alias("p")).toPandas()
    assert (out["label"] == out["prediction"]).mean() > 0.9 and all(len(p) == 3 and abs(sum(p) - 1) < 1e-9 for p in out["p"])


def test_shadows_permute_each_slot_without_shuffle_or_join(spark, monkeypatch):
    monkeypatch.setattr(selection, "SHADOW_ROWS", 500)
    df, x, y = linear_data(spark, 4000)
    rows = selection.dealt(df, "features")
    data = selection.shadow_features(rows, 7, "both")
    assert not any(k in data._jdf.queryExecution().toString() for k in ("Exchange", "Join"))  # four row orders and three joins before
    got = data.toPandas()
    both, label = np.stack(got["both"].map(lambda v: v.toArray())), got["label"].to_numpy()
    assert sorted(map(tuple, np.column_stack([both[:, :3], label]))) == sorted(map(tuple, np.column_stack([x, y])))
    for j in range(3):
        assert np.array_equal(np.sort(both[:, 3 + j]), np.sort(x[:, j]))
        assert (both[:, 3 + j] != both[:, j]).mean() > 0.9 and abs(np.corrcoef(both[:, 3 + j], label)[0, 1]) < 0.1
    assert abs(np.corrcoef(both[:, 3], both[:, 5])[0, 1]) < 0.1  # each slot by itself
    again = selection.shadow_features(rows, 8, "both").toPandas()
    assert not np.array_equal(both[:, 3:], np.stack(again["both"].map(lambda v: v.toArray()))[:, 3:])


def test_prepared_rows_come_in_bounded_tasks(spark, folder, monkeypatch):
    from lakelens.registry import model_queries as mq

    monkeypatch.setattr(mq, "FIT_ROWS", 100)
    monkeypatch.setattr(mq, "_ready", {})
    train, test, _ = mq.ready(spark, folder)
    per_file = [r["n"] for r in train.unionByName(test).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert max(per_file) <= 100 and sum(per_file) == mq.line_model_rows(spark, folder).distinct().count()


def test_selection_query_runs_all_rounds_of_boruta(spark, folder, monkeypatch):
    from lakelens.registry import model_queries as mq

    seen = []

    def fit(self, df):
        seen.append(self.isDefined(self.rounds))  # six rounds before, by which no slot of eight can be confirmed
        return selection.SelectedFeatures()._set(indices=[0])

    monkeypatch.setattr(selection.Boruta, "_fit", fit)
    mq._selected(spark, folder, "boruta", "l_extendedprice")
    assert seen == [False]
