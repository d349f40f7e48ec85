"""Predictive models, model selection, feature selection, imputation forests and explanations."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lakelens.functions.columns import col, r
from lakelens.operators import cv, explain, metrics, models, prep, selection, split
from lakelens.operators.impute import ForestImputer
from lakelens.plans.session import cut
from lakelens.registry.base import GAPS, LINE_ID, query, with_gaps
from lakelens.sources.io import load_pipeline, save_pipeline, table

FIT_ROWS = 25_000  # rows of a file of prepared rows: learners keep a task's rows in memory, as objects of up to some 100 bytes
BODY = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus"]
_ready: dict = {}


def line_model_rows(spark, d):
    """lineitem with a numeric and a categorical target; l_tax and l_returnflag have gaps."""
    li = with_gaps(spark, d)
    return li.select(*LINE_ID[:3], *BODY, "l_extendedprice", F.when(F.col("l_extendedprice") > 40000, "big").otherwise("small").alias("size_class"))


def ready(spark, d, target="l_extendedprice"):
    """(train, test, names): prepared once per session and folder, kept as written tables."""
    key = (spark.sparkContext.applicationId, d, target)
    if key not in _ready:
        rows = line_model_rows(spark, d)
        work, operation, _ = cv.prepare_target(rows, target)
        parts = cut(split.train_test_split(work, target, LINE_ID))
        train = parts.where("is_train")
        fitted = cv.fit_preparation(train, BODY, {})
        out = cut(fitted.transform(parts).select(*LINE_ID[:4], "is_train", "features", "label"), FIT_ROWS)
        names = prep.feature_names(fitted.transform(parts))
        _ready[key] = (out.where("is_train"), out.where("NOT is_train"), names)
    return _ready[key]


CLASS_SLUGS = {
    "GaussianNaiveBayes": "k1", "LogisticRegression": "k2", "Lasso": "k3", "Ridge": "k4", "ElasticNet": "k5", "LDA": "k6", "SVM_L": "k7", "SVM_R": "k8",
    "DecisionTree": "k10", "RandomForest": "k11", "BoostedTrees": "k12", "NeuralNetwork": "k13",
}
REG_SLUGS = {
    "Linear_Regression": "k15", "Lasso": "k16_lasso", "ElasticNet": "k16_elastic", "Ridge": "k17", "Bayesian_Ridge": "k18", "SVM_L": "k20_linear", "SVM_R": "k20_rbf",
    "DecisionTree": "k21_tree", "RandomForest": "k21_forest", "BoostedTrees": "k22",
}
QUICK = {"RandomForest": {"numTrees": 20, "maxDepth": 6}, "BoostedTrees": {"maxIter": 10, "maxDepth": 4}, "NeuralNetwork": {"l1": 8, "l2": 4}}

for _name, _slug in CLASS_SLUGS.items():

    @query(f"{_slug}_{_name.lower()}")
    def _(spark, d, name=_name):
        train, test, names = ready(spark, d, "size_class")
        spec = models.classifiers(train.count(), len(names), True, 2)[name]
        out = spec.build(**QUICK.get(name, {})).fit(train.select("features", "label")).transform(test)
        return metrics.classification_scores(out, "label", "prediction")


for _name, _slug in REG_SLUGS.items():

    @query(f"{_slug}_{_name.lower()}_regression")
    def _(spark, d, name=_name):
        train, test, names = ready(spark, d)
        spec = models.regressors(train.count(), len(names))[name]
        out = spec.build(**QUICK.get(name, {})).fit(train.select("features", "label")).transform(test)
        return metrics.regression_scores(out, "label", "prediction")


@query("k14_margin_probabilities")
def _(spark, d):
    from pyspark.ml.classification import LinearSVC

    train, test, _ = ready(spark, d, "size_class")
    out = LinearSVC(regParam=0.01, maxIter=50).fit(train.select("features", "label")).transform(test)
    p = models.margin_probabilities(vector_to_array("rawPrediction")[1])
    return out.select(*LINE_ID[:4], p[0].alias("p0"), p[1].alias("p1"))


def customers(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", F.when(F.col("c_acctbal") + 100 * F.col("c_nationkey") > 5500, "rich").otherwise("other").alias("level"))


@query("m1_cross_validation")
def _(spark, d):
    got = cv.run(customers(spark, d), "level", ["c_custkey"], ["LogisticRegression", "DecisionTree"], folds=3, repeats=1)
    return got["cv"].drop("time")


@query("m2_model_selection")
def _(spark, d):
    return cv.run(customers(spark, d), "c_acctbal", ["c_custkey"], ["Linear_Regression", "DecisionTree"], folds=3, repeats=1)["test"]


@query("m3_random_search")
def _(spark, d):
    return cv.run(customers(spark, d), "level", ["c_custkey"], ["DecisionTree"], folds=3, repeats=1, trials=3)["trials"].drop("duration")


@query("m4_preparation_outside_folds")
def _(spark, d):
    return cv.run(customers(spark, d), "level", ["c_custkey"], ["LDA"], folds=3, repeats=1, prepare_inside_folds=False)["cv"].drop("time")


@query("m5_nested_cv")
def _(spark, d):
    return cv.run_nested(customers(spark, d), "level", ["c_custkey"], ["LDA"], outer=(2, 1), inner=(2, 1))["test"]


@query("g7_trial_history")
def _(spark, d):
    t = cv.run(customers(spark, d), "c_acctbal", ["c_custkey"], ["Ridge"], folds=2, repeats=1, trials=3)["trials"]
    return metrics.trial_history(t).drop("duration")


@query("f15_preparation_as_parameter")
def _(spark, d):
    out = None
    for scaler in ("zscore", "minmax"):
        for imputation in ("mean", "median"):
            got = cv.run(
                customers(spark, d), "level", ["c_custkey"], ["LDA"], folds=2, repeats=1, preparation={"scaler": scaler, "imputation_numerical": imputation}
            )["cv"].drop("time")
            got = got.withColumns({"scaler": F.lit(scaler), "imputation": F.lit(imputation)})
            out = got if out is None else out.unionByName(got)
    return out.groupBy("scaler", "imputation").agg(F.avg("F1").alias("F1"))


@query("e10_discrimination_threshold_bands")
def _(spark, d):
    from lakelens.operators import evaluate

    work, _, _ = cv.prepare_target(customers(spark, d), "level")
    base = cut(split.k_folds(work, ["c_custkey"], 3, target="level"))
    curves = []
    for fold in range(3):
        train, val = split.fold_parts(base, "fold", fold)
        prepared = cv.fit_preparation(train, ["c_nationkey", "c_acctbal", "c_mktsegment"], {})
        model = models.classifiers(100, 3, True, 2)["LogisticRegression"].build().fit(cv.transform_rows(prepared, train).select("features", "label"))
        scored = model.transform(cv.transform_rows(prepared, val).select("features", "label"))
        curves.append(evaluate.threshold_curve(evaluate.threshold_table(scored, "label", {1.0: vector_to_array("probability")[1]})))
    return evaluate.threshold_bands(curves)


@query("e11_learning_curve")
def _(spark, d):
    train, _, names = ready(spark, d)
    spec = models.regressors(1000, len(names))["Linear_Regression"]
    return cv.learning_curve(train.select(*LINE_ID[:4], "features", "label"), spec, "regression", LINE_ID[:4], fractions=(0.1, 1.0), folds=2)


# ---------------------------------------------------------------- decomposition and feature selection


@query("d1_pca_explained")
def _(spark, d):
    train, _, names = ready(spark, d)
    return selection.principal_components(train, names)["explained"]


@query("d1_pca_loadings")
def _(spark, d):
    train, _, names = ready(spark, d)
    return selection.principal_components(train, names)["loadings"]


@query("c17_pca_scores")
def _(spark, d):
    train, _, names = ready(spark, d)
    pc = selection.principal_components(train, names)["scores"]
    return pc.select(*LINE_ID[:4], *[F.col("pc")[i].alias(f"PC{i + 1}") for i in range(3)], "label")


def _selected(spark, d, method, target):
    operation = "regression" if target == "l_extendedprice" else "classification"
    train, _, names = ready(spark, d, target)
    model = selection.selector(method, operation)
    kept = model.fit(train.select("features", "label").withColumnRenamed("features", "all_features")).getOrDefault("indices")
    return spark.createDataFrame([(names[i], i in kept) for i in range(len(names))], "feature string, kept boolean")


for _slug, _method, _target in (
    ("d2_boruta", "boruta", "l_extendedprice"),
    ("d3_lasso_cv_classification", "lasso_cv", "size_class"),
    ("d4_lasso_cv_regression", "lasso_cv", "l_extendedprice"),
    ("d5_l1_svm_classification", "l1_svm", "size_class"),
    ("d6_linear_svr_regression", "l1_svm", "l_extendedprice"),
):

    @query(_slug)
    def _(spark, d, method=_method, target=_target):
        return _selected(spark, d, method, target)


@query("d8_feature_dropping_curve")
def _(spark, d):
    train, _, names = ready(spark, d)
    spec = models.regressors(train.count(), len(names))["Lasso"]
    return selection.dropping_curve(train.select(*LINE_ID[:4], "features", "label"), spec, "regression", LINE_ID[:4], fractions=(0.5, 1.0), folds=2)


@query("d9_selector_as_parameter")
def _(spark, d):
    out = None
    for method in (None, "lasso_cv", "l1_svm"):
        got = cv.run(customers(spark, d), "level", ["c_custkey"], ["LDA"], folds=2, repeats=1, feature_selection=method)["cv"]
        got = got.groupBy("model").agg(F.avg("F1").alias("F1")).withColumn("selector", F.lit(method or "none"))
        out = got if out is None else out.unionByName(got)
    return out


# ---------------------------------------------------------------- forest imputation


GAPPY = ("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def _imputed(spark, d, method, nums, cats):
    """Facts of every imputed column: cells that are still empty, that changed although they had a value, and filled cells out of the observed range or not among the observed values."""
    rows = with_gaps(spark, d).select(*GAPPY)
    m = ForestImputer(nums=nums, cats=cats, method=method).fit(rows)
    out = cut(m.transform(rows.withColumns({f"old_{c}": F.col(c) for c in nums + cats})))
    seen = rows.agg(*[F.struct(F.min(c), F.max(c)).alias(c) for c in nums + cats]).first()
    total = lambda hit: F.coalesce(F.sum(hit.cast("long")), F.lit(0))
    facts = None
    for c in nums + cats:
        gap, (lo, hi) = F.col(f"old_{c}").isNull(), seen[c]
        values = rows.select(F.col(c).alias("v")).where("v IS NOT NULL").distinct()
        filled = out.where(gap).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
        unobserved = F.coalesce(F.sum("n"), F.lit(0)) if method == "mice_forest" or c in cats else F.lit(None).cast("long")
        one = out.agg(
            F.count("*").alias("n_rows"),
            total(gap).alias("n_gaps"),
            total(F.col(c).isNull()).alias("n_empty"),
            total(~gap & ~F.col(c).eqNullSafe(F.col(f"old_{c}"))).alias("n_changed"),
            total(gap & ((F.col(c) < lo) | (F.col(c) > hi))).alias("n_outside"),
        )
        one = one.select(F.lit(c).alias("variable"), "*").join(filled.join(values, "v", "left_anti").agg(unobserved.alias("n_unobserved")), F.lit(True))  # one row each
        facts = one if facts is None else facts.unionByName(one)
    return facts


def _imputed_sql(nums, cats, mice):
    parts = [
        f"SELECT '{c}' AS variable, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_gaps, 0::BIGINT AS n_empty, 0::BIGINT AS n_changed, 0::BIGINT AS n_outside, "
        f"{'0' if mice or c in cats else 'NULL'}::BIGINT AS n_unobserved FROM m"
        for c in nums + cats
    ]
    return f"WITH {GAPS} " + " UNION ALL ".join(parts)


@query("f4_mice_forest", _imputed_sql(["l_quantity", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"], True))
def _(spark, d):
    return _imputed(spark, d, "mice_forest", ["l_quantity", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"])


@query("f5_miss_forest_numeric", _imputed_sql(["l_quantity", "l_discount", "l_tax"], [], False))
def _(spark, d):
    return _imputed(spark, d, "miss_forest", ["l_quantity", "l_discount", "l_tax"], [])


@query("f6_miss_forest_categorical", _imputed_sql(["l_quantity"], ["l_returnflag", "l_linestatus"], False))
def _(spark, d):
    return _imputed(spark, d, "miss_forest", ["l_quantity"], ["l_returnflag", "l_linestatus"])


# ---------------------------------------------------------------- explanations


def forest_model(spark, d):
    from pyspark.ml.regression import RandomForestRegressor

    train, test, names = ready(spark, d)
    return RandomForestRegressor(numTrees=5, maxDepth=4, seed=1).fit(train.select("features", "label")), test, names


def _with_id(df):
    return df.withColumn("row_id", F.concat_ws("|", *LINE_ID[:4]))


@query("xp1_partial_dependence")
def _(spark, d):
    m, test, names = forest_model(spark, d)
    return explain.partial_dependence(m, test, names, ["l_quantity", "l_tax"], points=20)


@query("xp1_ice_curves")
def _(spark, d):
    m, test, names = forest_model(spark, d)
    return explain.ice_curves(m, _with_id(test), "row_id", names, "l_quantity", fraction=0.05, points=20)


@query("xp2_permutation_shap")
def _(spark, d):
    m, test, names = forest_model(spark, d)
    return explain.permutation_shap(m, _with_id(test), "row_id", names, test)


@query("xp3_tree_shap")
def _(spark, d):
    m, test, names = forest_model(spark, d)
    return explain.tree_shap(m, _with_id(test), "row_id", names)[0]


_FEATS = {"price": "o_totalprice / 1000 - 150", "customer": "o_custkey / 100.0::DOUBLE - 3", "status": "CASE o_orderstatus WHEN 'F' THEN -1.5::DOUBLE WHEN 'O' THEN 0.25::DOUBLE ELSE 1 END"}
_XVAL = {"price": "o_totalprice", "customer": "o_custkey::DOUBLE", "status": "length(o_orderpriority)::DOUBLE"}
_SHAP = "sh AS (" + " UNION ALL ".join(f"SELECT o_orderkey, '{k}' AS feature, ({v})::DOUBLE AS shap, {_XVAL[k]} AS x FROM orders" for k, v in _FEATS.items()) + ")"


def attributions(spark, d):
    """Attribution-like table of orders: (o_orderkey, feature, shap) and (o_orderkey, feature, x)."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", -1.5).when(F.col("o_orderstatus") == "O", 0.25).otherwise(1.0)
    rows = F.array(
        F.struct(F.lit("price").alias("feature"), (F.col("o_totalprice") / 1000 - 150).alias("shap"), F.col("o_totalprice").alias("x")),
        F.struct(F.lit("customer").alias("feature"), (F.col("o_custkey") / 100.0 - 3).alias("shap"), F.col("o_custkey").cast("double").alias("x")),
        F.struct(F.lit("status").alias("feature"), status.alias("shap"), F.length("o_orderpriority").cast("double").alias("x")),
    )
    long = o.select("o_orderkey", F.explode(rows).alias("e")).select("o_orderkey", "e.*")
    return long.drop("x"), long.drop("shap")


@query("xp4_importance", f"WITH {_SHAP} SELECT feature, round(avg(abs(shap)), 6) AS importance FROM sh GROUP BY 1")
def _(spark, d):
    return explain.shap_importance(attributions(spark, d)[0]).select("feature", F.round("importance", 6).alias("importance"))


@query(
    "xp5_beeswarm",
    f"""WITH {_SHAP}, m AS (SELECT feature, avg(x) AS m, avg(abs(shap)) AS i FROM sh GROUP BY 1)
SELECT o_orderkey, feature, round(shap, 6) + 0.0 AS shap, CASE WHEN x <= m THEN 'low' ELSE 'high' END AS level, round(i, 6) AS importance FROM sh JOIN m USING (feature)""",
)
def _(spark, d):
    b = explain.beeswarm(*attributions(spark, d), "o_orderkey")
    return b.withColumns({"shap": r(F.col("shap")), "importance": F.round("importance", 6)})


@query(
    "xp6_dependence",
    f"WITH {_SHAP} SELECT a.o_orderkey, a.x, round(a.shap, 6) + 0.0 AS shap, b.x AS color FROM sh a JOIN sh b ON a.o_orderkey = b.o_orderkey AND a.feature = 'price' AND b.feature = 'customer'",
)
def _(spark, d):
    t = explain.dependence_table(*attributions(spark, d), "o_orderkey", "price", "customer")
    return t.withColumn("shap", r(F.col("shap")))


@query("xp7_local", f"WITH {_SHAP} SELECT feature, round(shap, 6) + 0.0 AS shap FROM sh WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders) ORDER BY shap")
def _(spark, d):
    long, _ = attributions(spark, d)
    first = table(spark, d, "orders").agg(F.min("o_orderkey")).first()[0]
    return explain.local_explanation(long, "o_orderkey", first).withColumn("shap", r(F.col("shap")))


@query("xp9_class_slice", f"WITH {_SHAP} SELECT o_orderkey, feature, round(shap, 6) + 0.0 AS shap FROM sh WHERE o_orderkey % 3 = 1")
def _(spark, d):
    long, _ = attributions(spark, d)
    return explain.class_slice(long.withColumn("class", (F.col("o_orderkey") % 3).cast("int")), 1).withColumn("shap", r(F.col("shap")))


@query("xp8_feature_clustering")
def _(spark, d):
    train, _, names = ready(spark, d)
    return explain.feature_clustering(train, names)


@query("xp10_treatment_effects")
def _(spark, d):
    train, _, names = ready(spark, d)
    folded = cut(split.k_folds(train, LINE_ID[:4], 5))
    return explain.average_treatment_effects(folded, names, "fold")


@query("xp10_treatment_effects_custom")
def _(spark, d):
    from pyspark.ml.regression import DecisionTreeRegressor

    work, _, _ = cv.prepare_target(customers(spark, d).drop("level"), "c_acctbal")
    fitted = cv.fit_preparation(work, ["c_nationkey", "c_mktsegment"], {})
    rows = cut(split.k_folds(fitted.transform(work), ["c_custkey"], 2).select("features", "label", "fold"))
    names = prep.feature_names(fitted.transform(work))
    return explain.average_treatment_effects(rows, names, "fold", outcome_model=DecisionTreeRegressor(maxDepth=3))


@query("y1_pipeline_round_trip")
def _(spark, d):
    import uuid

    from lakelens.plans.session import checkpoint_root

    rows = line_model_rows(spark, d).select(*BODY)
    m = prep.data_preprocessing(rows).fit(rows)
    path = f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"
    save_pipeline(m, path)
    x = lambda df: vector_to_array("features")
    a = m.transform(rows).select(F.xxhash64(x(rows)).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    b = load_pipeline(path).transform(rows).select(F.xxhash64(x(rows)).alias("h")).groupBy("h").agg(F.count("*").alias("m"))
    return a.join(b, "h", "full").agg(F.sum((F.col("n").eqNullSafe(F.col("m"))).cast("int")).alias("same"), F.count("*").alias("vectors"))
