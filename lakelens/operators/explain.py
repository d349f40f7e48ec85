"""Explanations of fitted models and double machine learning."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.functions.columns import col
from lakelens.functions.dist import norm_two_sided
from lakelens.operators.profile import report
from lakelens.operators.split import unit_hash
from lakelens.plans.matrix import array_udf, as_array, gram, stack, sum_matrices
from lakelens.plans.quantiles import exact_quantiles
from lakelens.plans.session import cut

SEED = 123
EVALUATIONS = 4_000_000  # model evaluations of one task of permutation_shap
LEAF_NUMBERS = 4_000_000  # numbers in the leaf tables of a tree model; larger models are evaluated row by row


def _scored(model, df: DataFrame, target: int | None) -> DataFrame:
    """Model output as ``f``: the prediction, or the probability of class ``target``."""
    out = model.transform(df)
    f = col("prediction") if target is None else vector_to_array(col("probability"))[target]
    return out.withColumn("f", f.cast("double"))


# ---------------------------------------------------------------- partial dependence


def grid_values(df: DataFrame, slot: int, points: int = 100, features: str = "features") -> list[float]:
    """All distinct values when there are few, else an even grid between the 5 % and 95 % quantiles."""
    x = df.select(as_array(df, features)[slot].alias("x"))
    few = [r["x"] for r in x.distinct().limit(points + 1).collect()]
    if len(few) <= points:
        return sorted(few)
    lo, hi = exact_quantiles(x, ["x"], [0.05, 0.95])["x"]
    return [float(v) for v in np.linspace(lo, hi, points)]


def _with_slot(df: DataFrame, slot: int, grid: list[float], features: str) -> DataFrame:
    at = df.withColumn("grid", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    moved = F.transform(as_array(df, features), lambda v, i: F.when(i == slot, F.col("grid")).otherwise(v))
    return at.withColumn(features, array_to_vector(moved))


def partial_dependence(model, df: DataFrame, names: list[str], wanted: list[str] | None = None, target: int | None = None, points: int = 100, features: str = "features") -> DataFrame:
    """(feature, grid, average): one transform per feature over rows x grid, averaged on the executors."""
    out = None
    for name in wanted or names:
        slot = names.index(name)
        at = _scored(model, _with_slot(df.select(features), slot, grid_values(df, slot, points, features), features), target)
        part = at.groupBy("grid").agg(F.avg("f").alias("average")).select(F.lit(name).alias("feature"), "grid", "average")
        out = part if out is None else out.unionByName(part)
    return out


def ice_curves(model, df: DataFrame, id_col: str, names: list[str], name: str, fraction: float = 0.1, target: int | None = None, points: int = 100, features: str = "features") -> DataFrame:
    """(id, grid, f): individual curves of a hash-chosen share of the rows."""
    slot = names.index(name)
    grid = grid_values(df, slot, points, features)
    some = df.where(unit_hash([id_col], SEED) < fraction).select(id_col, features)
    return _scored(model, _with_slot(some, slot, grid, features), target).select(id_col, "grid", "f")


# ---------------------------------------------------------------- Shapley values


def permutation_shap(model, df: DataFrame, id_col: str, names: list[str], background: DataFrame, target: int | None = None, permutations: int = 5, features: str = "features", max_background: int = 100) -> DataFrame:
    """(id, feature, shap) of every row, by permutations walked forward and backward against a bounded background.

    Each different prefix of the permutations is a coalition. Executors expand a row to coalitions x background
    rows, ONE transform scores them, and the scores are summed by row with the weight that the coalition has for
    each feature. The coalition of all features is the row itself; that of none is scored once for all rows. For
    each row the values add up to f(x) - mean f(background). The background is the ``max_background`` vectors
    with the smallest hashes: a sample that does not depend on their order or size.

    Where the output is a sum over trees, a coalition needs no model call for each background row: a leaf counts by the
    conditions that the row meets inside the coalition and the share of the background that meets those outside it. The
    values are the same sums, in other order, and work by row no longer depends on coalitions x background rows.
    """
    bg = np.array([r["v"] for r in background.select(as_array(background, features).alias("v")).orderBy(F.xxhash64("v"), "v").limit(max_background).collect()])
    p = len(names)
    rng = np.random.default_rng(SEED)
    orders = [o for _ in range(permutations) for o in (lambda q: (q, q[::-1]))(rng.permutation(p))]
    gain: dict[tuple, np.ndarray] = {}
    for order in orders:
        for j, f in enumerate(order):
            for size, sign in ((j, -1.0), (j + 1, 1.0)):
                gain.setdefault(tuple(sorted(order[:size].tolist())), np.zeros(p))[f] += sign / len(orders)
    none, every = gain.pop(()), gain.pop(tuple(range(p)))
    masks = np.zeros((len(gain), p), dtype=bool)
    for k, members in enumerate(gain):
        masks[k, list(members)] = True
    weights = np.vstack([*[g / len(bg) for g in gain.values()], every])
    spark, base_type = df.sparkSession, dict(df.dtypes)[id_col]
    if _is_tree_sum(model, target, p):
        return _leaf_shap(model, df, id_col, names, features, target, bg, np.vstack([np.zeros(p, dtype=bool), masks, np.ones(p, dtype=bool)]), np.vstack([none, *gain.values(), every]))
    start = _scored(model, spark.createDataFrame([(v.tolist(),) for v in bg], "v array<double>").withColumn(features, array_to_vector("v")), target).agg(F.avg("f")).first()[0]
    which = np.append(np.repeat(np.arange(len(masks)), len(bg)), len(masks)).astype(np.int32)
    offsets = np.arange(len(which) + 1, dtype=np.int32) * p

    def expand(batches):
        for batch in batches:
            for i, x in enumerate(batch.column(1).to_pylist()):
                x = np.asarray(x)
                z = np.vstack([np.where(masks[:, None, :], x, bg[None]).reshape(-1, p), x])
                rid = batch.column(0).take(pa.array(np.full(len(which), i)))
                yield pa.RecordBatch.from_arrays([rid, pa.array(which), pa.ListArray.from_arrays(pa.array(offsets), pa.array(z.ravel()))], names=["id", "k", "v"])

    rows = df.select(col(id_col).alias("id"), as_array(df, features).alias("v"))
    rows = rows.repartition(max(1, math.ceil(df.count() * len(which) / EVALUATIONS)), "id")  # bounded tasks
    big = rows.mapInArrow(expand, f"id {base_type}, k int, v array<double>")
    scored = _scored(model, big.withColumn(features, array_to_vector("v")), target)
    part = lambda i: F.sum(F.col("f") * F.get(F.array(*[F.lit(float(w)) for w in weights[:, i]]), F.col("k")))
    copies = F.sum((F.col("k") == len(masks)).cast("long"))  # rows that repeat an id are averaged
    sums = scored.groupBy("id").agg(F.array(*[part(i) / copies + F.lit(float(none[i]) * start) for i in range(p)]).alias("shap"))
    named = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("shap"))
    return sums.select(F.col("id").alias(id_col), F.explode(named).alias("e")).select(id_col, "e.feature", "e.shap")


def _is_tree_sum(model, target: int | None, p: int) -> bool:
    """Whether the output (see ``_scored``) is a weighted sum of leaf values, with leaf tables of at most LEAF_NUMBERS."""
    single = ("DecisionTreeRegressionModel",) if target is None else ("DecisionTreeClassificationModel",)
    many = ("RandomForestRegressionModel", "GBTRegressionModel") if target is None else ("RandomForestClassificationModel",)
    if type(model).__name__ not in single + many:
        return False
    trees = [model] if type(model).__name__ in single else model.trees
    return sum(t.numNodes * 2 ** min(t.depth, p) * p for t in trees) <= LEAF_NUMBERS


def tree_table(model, classification: bool, target: int = 0) -> list[tuple[float, dict]]:
    """(weight, nodes) of every tree of a fitted tree model, read from the saved model's node table.

    A node is (feature, threshold, left categories or None, left, right, value, cover). The impurity
    statistics tell what a tree is: class counts in classification trees, whose values are class shares;
    (count, sum, sum of squares) in regression trees, boosted classifiers included, whose values are predictions. A boosted
    model adds its trees with their own weights (the margin), all others average them.
    """
    import uuid

    from pyspark.sql import SparkSession

    from lakelens.plans.session import checkpoint_root

    spark = SparkSession.getActiveSession()
    path = f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    many = "treeID" in data.columns
    flat = data.select(F.col("treeID") if many else F.lit(0).alias("treeID"), F.col("nodeData.*") if many else F.col("*"))
    rows = flat.collect()  # the nodes of the model itself
    weights = list(getattr(model, "treeWeights", [1.0]))
    boosted = type(model).__name__.startswith("GBT")
    trees: dict[int, dict] = {}
    for r in rows:
        stats = list(r["impurityStats"])
        if classification and not boosted:
            value, cover = stats[target] / sum(stats), sum(stats)
        else:
            value, cover = r["prediction"], stats[0]
        left = r["leftChild"]
        f, t, some = -1, 0.0, None
        if left >= 0:
            f, given = r["split"]["featureIndex"], list(r["split"]["leftCategoriesOrThreshold"])
            if r["split"]["numCategories"] >= 0:
                some = frozenset(given)
            else:
                t = given[0]
        trees.setdefault(r["treeID"], {})[r["id"]] = (f, t, some, left, r["rightChild"], value, cover)
    total = 1.0 if boosted else sum(weights)
    return [(weights[i] / total if len(weights) > i else 1.0, trees[i]) for i in sorted(trees)]


def _leaf_paths(nodes: dict) -> list[tuple[float, list[tuple]]]:
    """(leaf value, [(feature, low, high, allowed categories or None, excluded categories, cover ratio)]): repeated features are merged."""
    out = []

    def walk(i, path):
        f, t, some, left, right, value, cover = nodes[i]
        if left < 0:
            out.append((value, [(k, *v) for k, v in path.items()]))
            return
        for child, is_left in ((left, True), (right, False)):
            ratio = nodes[child][6] / cover
            low, high, only, never, z = path.get(f, (-math.inf, math.inf, None, frozenset(), 1.0))
            if some is None:
                low, high = (low, min(high, t)) if is_left else (max(low, t), high)
            elif is_left:
                only = some if only is None else only & some
            else:
                never = never | some
            walk(child, {**path, f: (low, high, only, never, z * ratio)})

    walk(0, {})
    return out


def _holds(x: np.ndarray, low: float, high: float, only: frozenset | None, never: frozenset) -> np.ndarray:
    """As a model walks: NaN is not below any threshold, so it goes to the right."""
    ok = ~(x <= low) if low > -math.inf else np.ones(len(x), dtype=bool)
    if high < math.inf:
        ok &= x <= high
    if only is not None:
        ok &= np.isin(x, list(only))
    if never:
        ok &= ~np.isin(x, list(never))
    return ok


def _meets(x: np.ndarray, low: float, high: float, only: frozenset | None, never: frozenset) -> np.ndarray:
    ok = (x > low) & (x <= high)
    if only is not None:
        ok &= np.isin(x, list(only))
    if never:
        ok &= ~np.isin(x, list(never))
    return ok.astype(float)


def _leaf_shap(model, df: DataFrame, id_col: str, names: list[str], features: str, target: int | None, bg: np.ndarray, masks: np.ndarray, gains: np.ndarray) -> DataFrame:
    """(id, feature, shap) as the sum over coalitions (rows of ``masks``) of their gains x mean output, leaf by leaf.

    A leaf whose path has m features gives a row one of 2^m vectors, by which of the conditions it meets. The vectors
    are summed from those of its subsets, so a leaf costs 2^m numbers here and m comparisons a row.
    """
    p, leaves = len(names), []
    for w, nodes in tree_table(model, target is not None, target or 0):
        for value, path in _leaf_paths(nodes):
            rules = [(f, low, high, only, never) for f, low, high, only, never, _ in path]
            m = len(rules)
            met = np.array([_holds(bg[:, f], *rule) for f, *rule in rules], dtype=bool).reshape(m, len(bg))
            inside = masks[:, [f for f, *_ in rules]].astype(np.int64) @ (1 << np.arange(m)) if m else np.zeros(len(masks), dtype=np.int64)
            table = np.zeros((1 << m, p))  # by the features of the leaf that are in the coalition
            np.add.at(table, inside, gains)
            for s in range(1 << m):
                table[s] *= w * value * met[[i for i in range(m) if not s >> i & 1]].all(axis=0).mean()
            for i in range(m):  # the row must meet every condition inside the coalition
                has = (np.arange(1 << m) >> i & 1).astype(bool)
                table[has] += table[~has]
            leaves.append((rules, table))

    def attribute(x):
        phi = np.zeros((len(x), p))
        for rules, table in leaves:
            at = np.zeros(len(x), dtype=np.int64)
            for i, (f, *rule) in enumerate(rules):
                at |= _holds(x[:, f], *rule).astype(np.int64) << i
            phi += table[at]
        return phi

    rows = df.select(col(id_col).alias("id"), array_udf(attribute, "array<double>")(as_array(df, features)).alias("shap"))
    mean = rows.groupBy("id").agg(F.array(*[F.avg(F.col("shap")[i]) for i in range(p)]).alias("shap"))  # rows that repeat an id are averaged
    named = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("shap"))
    return mean.select(F.col("id").alias(id_col), F.explode(named).alias("e")).select(id_col, "e.feature", "e.shap")


def tree_shap(model, df: DataFrame, id_col: str, names: list[str], classification: bool = False, target: int = 0, features: str = "features") -> tuple[DataFrame, float]:
    """((id, feature, shap), base value): exact path-dependent attribution of tree models.

    Values and base add up to the prediction of a regression model, to the probability of class ``target``
    of a classification tree or forest, and to the margin of a boosted classifier.

    For one leaf with m path features the value of feature i is
    v (o_i - z_i) sum_k k! (m-1-k)! / m! [t^k] prod_{j != i} (z_j + o_j t), where o_j says whether the row
    meets the condition and z_j is the cover share. It is evaluated for whole Arrow batches at once.
    """
    forest = [(w, _leaf_paths(nodes)) for w, nodes in tree_table(model, classification, target)]
    p = len(names)
    base = sum(w * v * math.prod(z for *_, z in path) for w, leaves in forest for v, path in leaves)

    def attribute(x):
        phi = np.zeros((len(x), p))
        for w, leaves in forest:
            for value, path in leaves:
                m = len(path)
                if not m or value == 0:
                    continue
                o = np.stack([_meets(x[:, f], *rule) for f, *rule, _ in path])
                z = np.array([q for *_, q in path])
                weight = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
                for i in range(m):
                    poly = np.zeros((m, len(x)))
                    poly[0] = 1.0
                    for j in range(m):
                        if j != i:
                            poly[1:] = poly[1:] * z[j] + poly[:-1] * o[j]
                            poly[0] = poly[0] * z[j]
                    phi[:, path[i][0]] += w * value * (o[i] - z[i]) * (weight @ poly)
        return phi

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "phi": list(attribute(stack(pdf["v"])))})

    rows = df.select(col(id_col).alias("id"), as_array(df, features).alias("v")).mapInPandas(run, f"id {dict(df.dtypes)[id_col]}, phi array<double>")
    long = rows.select(F.col("id").alias(id_col), F.posexplode("phi").alias("i", "shap"))
    return long.select(id_col, F.get(F.array(*[F.lit(n) for n in names]), F.col("i")).alias("feature"), "shap"), float(base)


def shap_importance(long: DataFrame) -> DataFrame:
    """(feature, importance): mean absolute value."""
    return long.groupBy("feature").agg(F.avg(F.abs("shap")).alias("importance"))


def beeswarm(long: DataFrame, values: DataFrame, id_col: str) -> DataFrame:
    """(feature, shap, level, importance): ``values`` is (id, feature, x); level is low up to the mean."""
    means = values.groupBy("feature").agg(F.avg("x").alias("m"))  # one row per feature
    imp = shap_importance(long)
    level = F.when(F.col("x") <= F.col("m"), "low").otherwise("high")
    return (
        long.join(values, [id_col, "feature"])
        .join(F.broadcast(means), "feature")
        .join(F.broadcast(imp), "feature")
        .select(id_col, "feature", "shap", level.alias("level"), "importance")
    )


def feature_values(df: DataFrame, id_col: str, names: list[str], features: str = "features") -> DataFrame:
    """(id, feature, x) of a vector column."""
    labels = F.array(*[F.lit(n) for n in names])
    return df.select(col(id_col), F.posexplode(as_array(df, features)).alias("i", "x")).select(id_col, F.get(labels, F.col("i")).alias("feature"), "x")


def dependence_table(long: DataFrame, values: DataFrame, id_col: str, feature: str, color: str | None = None) -> DataFrame:
    """(id, x, shap, color) of one feature, coloured by another one."""
    one = long.where(F.col("feature") == feature).join(values.where(F.col("feature") == feature).drop("feature"), id_col).drop("feature")
    if color is None:
        return one.select(id_col, "x", "shap")
    return one.join(values.where(F.col("feature") == color).select(id_col, F.col("x").alias("color")), id_col).select(id_col, "x", "shap", "color")


def local_explanation(long: DataFrame, id_col: str, row) -> DataFrame:
    return long.where(col(id_col) == F.lit(row)).select("feature", "shap").orderBy("shap")


def class_slice(by_class: DataFrame, chosen: int | None = None) -> DataFrame:
    """One class of a (class, ...) attribution table: class 0 unless chosen."""
    return by_class.where(F.col("class") == F.lit(chosen or 0)).drop("class")


def feature_clustering(wide: DataFrame, names: list[str], features: str = "features", method: str = "complete") -> DataFrame:
    """(step, left, right, distance, size): linkage of feature columns; distances come from one Gram matrix."""
    g = gram(wide, features)[""][1:, 1:]
    d = np.sqrt(np.maximum(np.diag(g)[:, None] + np.diag(g)[None, :] - 2 * g, 0))
    groups = {i: [i] for i in range(len(names))}
    label = {i: n for i, n in enumerate(names)}
    rows = []
    pick = {"complete": np.max, "single": np.min, "average": np.mean}[method]
    while len(groups) > 1:
        keys = sorted(groups)
        dist, a, b = min((float(pick(d[np.ix_(groups[a], groups[b])])), a, b) for i, a in enumerate(keys) for b in keys[i + 1 :])
        groups[a] = groups[a] + groups.pop(b)
        rows.append((len(rows) + 1, label[a], label[b], dist, len(groups[a])))
        label[a] = f"node{len(rows)}"
    return report(wide.sparkSession, rows, "step int, left string, right string, distance double, size int")


# ---------------------------------------------------------------- treatment effects


def average_treatment_effects(df: DataFrame, names: list[str], fold: str, label: str = "label", features: str = "features", outcome_model=None) -> DataFrame:
    """(feature, ate, std_error, p_value): every feature in turn as treatment, the others as controls.

    Cross-fitting by the fold column. With linear nuisance models the coefficients of all treatments and
    folds follow from the per-fold Gram matrices (one pass); a second pass adds up the residual moments.
    ``outcome_model`` (an estimator) replaces the linear model of the outcome and is refitted per feature
    and fold.
    """
    parts = gram(df, features, extra=[label], by=fold)
    total = sum(parts.values())
    p = len(names)
    coefs: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for k, g in parts.items():
        m = total - g
        ty, tt = np.zeros((p, p + 1)), np.zeros((p, p + 1))
        for j in range(p):
            keep = [0] + [i + 1 for i in range(p) if i != j]
            inv = np.linalg.pinv(m[np.ix_(keep, keep)])
            ty[j, keep] = inv @ m[keep, p + 1]
            tt[j, keep] = inv @ m[keep, j + 1]
        coefs[k] = (ty, tt)
    columns = [as_array(df, features).alias("v"), col(label).cast("double").alias("y"), col(fold).cast("string").alias("k")]

    def residuals(pdf):
        x, y = stack(pdf["v"]), pdf["y"].to_numpy(float)
        z = np.hstack([np.ones((len(x), 1)), x])
        ry, rt = np.empty((len(x), p)), np.empty((len(x), p))
        for k, ix in pdf.reset_index(drop=True).groupby("k").indices.items():
            ty, tt = coefs[k]
            ry[ix] = y[ix, None] - z[ix] @ ty.T
            rt[ix] = x[ix] - z[ix] @ tt.T
        return ry, rt

    if outcome_model is None:

        def first(pdf):
            ry, rt = residuals(pdf)
            return {"yt": (ry * rt).sum(axis=0), "tt": (rt * rt).sum(axis=0)}

        s = sum_matrices(df, columns, first)
        theta = s["yt"] / s["tt"]

        def second(pdf):
            ry, rt = residuals(pdf)
            return {"v": ((rt * (ry - theta * rt)) ** 2).sum(axis=0)}

        v = sum_matrices(df, columns, second)["v"]
    else:
        sums = [_custom_residuals(df, names, j, fold, label, features, outcome_model, coefs) for j in range(p)]
        theta, v, s = np.array([a for a, *_ in sums]), np.array([b for _, b, _ in sums]), {"tt": np.array([c for *_, c in sums])}
    n = total[0, 0]
    se = np.sqrt(n / (n - 1) * v) / s["tt"]
    return report(
        df.sparkSession,
        [(name, theta[j], se[j], norm_two_sided(theta[j] / se[j]) if se[j] > 0 else math.nan) for j, name in enumerate(names)],
        "feature string, ate double, std_error double, p_value double",
    )


def _custom_residuals(df, names, j, fold, label, features, outcome_model, coefs):
    """(theta, sum of squared scores, sum of squared treatment residuals) of one treatment."""
    x = as_array(df, features)
    controls = F.filter(x, lambda v, i: i != j)
    base = df.select(x.alias("v"), array_to_vector(controls).alias("features"), col(label).cast("double").alias("label"), col(fold).cast("string").alias("k"))
    scored = None
    for k in coefs:
        model = outcome_model.fit(base.where(F.col("k") != k))
        part = model.transform(base.where(F.col("k") == k)).select("v", "k", (F.col("label") - F.col("prediction")).alias("ry"))
        scored = part if scored is None else scored.unionByName(part)

    def rt_of(pdf):
        v = stack(pdf["v"])
        z = np.hstack([np.ones((len(v), 1)), v])
        w = np.stack([coefs[k][1][j] for k in pdf["k"]])
        return v[:, j] - (z * w).sum(axis=1)

    scored = cut(scored)
    cols = [F.col("v"), F.col("k"), F.col("ry")]

    def first(pdf):
        rt, ry = rt_of(pdf), pdf["ry"].to_numpy(float)
        return {"s": np.array([ry @ rt, rt @ rt])}

    yt, tt = sum_matrices(scored, cols, first)["s"]
    theta = yt / tt

    def second(pdf):
        rt, ry = rt_of(pdf), pdf["ry"].to_numpy(float)
        return {"v": np.array([((rt * (ry - theta * rt)) ** 2).sum()])}

    return theta, sum_matrices(scored, cols, second)["v"][0], tt
