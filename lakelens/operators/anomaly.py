"""Outlier detectors on prepared features, scores scaled to [0, 1], and their cross-validation."""

from __future__ import annotations

import math
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelens.functions.columns import col, number
from lakelens.operators.cluster import kmeans
from lakelens.operators.knn import distances, knn_join
from lakelens.operators.profile import report
from lakelens.plans.matrix import array_udf, as_array, gram, moments, stack, sum_matrices
from lakelens.plans.quantiles import exact_quantiles
from lakelens.plans.ranking import running_totals, value_counts_long
from lakelens.plans.session import BROADCAST_NUMBERS, cut, lookup

SEED = 123

# Detector names and their default parameters.
MODELS = ("CBLOF", "COPOD", "ECOD", "HBOS", "Iforest", "KNN", "LODA", "LOF", "MCD", "PCA")
HBOS_BINS, HBOS_ALPHA = 10, 0.1
KNN_NEIGHBOURS, LOF_NEIGHBOURS = 5, 20
CBLOF_CLUSTERS, CBLOF_ALPHA, CBLOF_BETA = 8, 0.9, 5
FOREST_TREES, FOREST_SAMPLE = 100, 256
LODA_CUTS, LODA_BINS = 100, 10


def _wide(df: DataFrame, features: str) -> tuple[DataFrame, list[str]]:
    """One double column per slot, for detectors that work feature by feature."""
    first = df.select(F.size(as_array(df, features)).alias("n")).first()
    names = [f"__f{i}" for i in range(first["n"] if first else 0)]
    v = as_array(df, features)
    return df.withColumns({c: v[i] for i, c in enumerate(names)}), names


def hbos(df: DataFrame, features: str = "features") -> DataFrame:
    """Sum over features of -log2(density + 0.1) from ten equal-width bins per feature.

    Bins are counted left-closed (the last one closed) and looked up right-closed, as in the usual
    implementation.
    """
    wide, names = _wide(df, features)
    ends = wide.agg(*[F.struct(F.min(c), F.max(c)).alias(c) for c in names], F.count("*").alias("n")).first()
    n = ends["n"]
    lo = [ends[c][0] for c in names]
    hi = [ends[c][1] for c in names]
    flat = [a == b for a, b in zip(lo, hi)]
    lo = [a - 0.5 if f else a for a, f in zip(lo, flat)]
    hi = [b + 0.5 if f else b for b, f in zip(hi, flat)]
    step = [(b - a) / HBOS_BINS for a, b in zip(lo, hi)]
    edges = [[a + s * j for j in range(HBOS_BINS)] + [b] for a, b, s in zip(lo, hi, step)]
    aggs = []
    for i, c in enumerate(names):
        for j in range(HBOS_BINS):
            inside = (F.col(c) >= edges[i][j]) & ((F.col(c) <= edges[i][j + 1]) if j == HBOS_BINS - 1 else (F.col(c) < edges[i][j + 1]))
            aggs.append(F.count(F.when(inside, 1)).alias(f"h{i}_{j}"))
    counts = wide.agg(*aggs).first()
    total = F.lit(0.0)
    for i, c in enumerate(names):
        out = [-math.log2(counts[f"h{i}_{j}"] / n / step[i] + HBOS_ALPHA) for j in range(HBOS_BINS)]
        at = sum((F.col(c) > edges[i][j]).cast("int") for j in range(1, HBOS_BINS))
        total = total + F.get(F.array(*[F.lit(v) for v in out]), at)
    return wide.withColumn("raw_score", total).drop(*names)


def _tails(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """Attach -log of the left and right ECDF of every feature; also each feature's skewness sign."""
    counts = value_counts_long(df, names)
    cum = cut(running_totals(counts, "value", ["n"], by=["variable"], few_groups=True))
    row = df.agg(F.count("*").alias("n"), *[F.skewness(c).alias(c) for c in names]).first()
    n = float(row["n"])
    for c in names:
        part = cum.where(F.col("variable") == c).select(
            F.col("value").alias("__k"),
            F.col("n").alias("__n"),
            (-F.ln(F.col("n_cum") / n)).alias(f"{c}_l"),
            (-F.ln((n - F.col("n_cum") + F.col("n")) / n)).alias(f"{c}_r"),
        )
        df = lookup(df.withColumn("__k", F.col(c) + F.lit(0.0)), part, "__k", "__n", BROADCAST_NUMBERS).drop("__k")
    sign = {c: 0.0 if row[c] is None or math.isnan(row[c]) else float(np.sign(row[c])) for c in names}
    return df, sign


def _tail_score(df: DataFrame, features: str, copula: bool) -> DataFrame:
    keep = df.columns
    wide, names = _wide(df, features)
    t, sign = _tails(wide, names)
    total = F.lit(0.0)
    for c in names:
        left, right = F.col(f"{c}_l"), F.col(f"{c}_r")
        skewed = {-1.0: left, 1.0: right}.get(sign[c], left + right)
        total = total + (F.greatest(skewed, (left + right) / 2) if copula else F.greatest(skewed, left, right))
    return t.withColumn("raw_score", total).select(*[col(c) for c in keep], "raw_score")


def ecod(df: DataFrame, features: str = "features") -> DataFrame:
    """Sum over features of the largest of left, right and skewness-chosen -log tail probability."""
    return _tail_score(df, features, copula=False)


def copod(df: DataFrame, features: str = "features") -> DataFrame:
    """As ECOD, but the larger of the skewness-chosen tail and the mean of both tails."""
    return _tail_score(df, features, copula=True)


def pca_score(df: DataFrame, features: str = "features") -> DataFrame:
    """Sum of squared standardised projections on the principal axes, each divided by its eigenvalue."""
    n, mean, cov = moments(gram(df, features)[""], ddof=0)
    sd = np.sqrt(np.diag(cov))
    sd = np.where(sd > 0, sd, 1.0)
    val, vec = np.linalg.eigh(cov / np.outer(sd, sd))
    keep = val > 1e-10 * val.max()
    axes, val = vec[:, keep], val[keep]
    score = array_udf(lambda x: ((((x - mean) / sd) @ axes) ** 2 / val).sum(axis=1), "double")
    return df.withColumn("raw_score", score(as_array(df, features)))


def knn_score(df: DataFrame, id_col: str, features: str = "features", k: int = KNN_NEIGHBOURS) -> DataFrame:
    """Distance to the k-th nearest neighbour."""
    near = knn_join(df, df, id_col, features, k)
    return df.join(near.groupBy(id_col).agg(F.max("distance").alias("raw_score")), id_col)


def lof(df: DataFrame, id_col: str, features: str = "features", k: int = LOF_NEIGHBOURS) -> DataFrame:
    """Local outlier factor from the k-neighbour table: two joins on neighbour ids."""
    near = cut(knn_join(df, df, id_col, features, k))
    reach = near.groupBy(id_col).agg(F.max("distance").alias("kd"), F.count("*").alias("m"))
    with_kd = near.join(reach.select(F.col(id_col).alias("neighbour"), "kd"), "neighbour")
    lrd = cut(with_kd.groupBy(id_col).agg((1.0 / (F.avg(F.greatest("distance", "kd")) + 1e-10)).alias("lrd")))
    other = near.join(lrd.select(F.col(id_col).alias("neighbour"), F.col("lrd").alias("o")), "neighbour")
    mean = other.groupBy(id_col).agg(F.avg("o").alias("o"))
    return df.join(mean.join(lrd, id_col).select(id_col, (F.col("o") / F.col("lrd")).alias("raw_score")), id_col)


def large_clusters(sizes: list[int], alpha: float = CBLOF_ALPHA, beta: float = CBLOF_BETA) -> int:
    """How many of the clusters (sizes descending) count as large."""
    n = sum(sizes)
    by_share = [i for i in range(1, len(sizes)) if sum(sizes[:i]) >= n * alpha]
    by_drop = [i for i in range(1, len(sizes)) if sizes[i] and sizes[i - 1] / sizes[i] >= beta]
    both = sorted(set(by_share) & set(by_drop))
    for option in (both, by_share, by_drop):
        if option:
            return option[0]
    return len(sizes)


def cblof(df: DataFrame, features: str = "features", clusters: int = CBLOF_CLUSTERS, centres: np.ndarray | None = None) -> DataFrame:
    """Distance to the own centre (large clusters) or to the nearest large centre (small ones)."""
    if centres is None:
        _, centres = kmeans(df, clusters, features)
    nearest = array_udf(lambda x: distances(x, centres).argmin(axis=1).astype("int32"), "int")
    labelled = df.withColumn("__c", nearest(as_array(df, features)))
    sizes = dict(labelled.groupBy("__c").agg(F.count("*")).collect())
    order = sorted(range(len(centres)), key=lambda j: (-sizes.get(j, 0), j))
    large = set(order[: large_clusters([sizes.get(j, 0) for j in order])])
    big = centres[sorted(large)]

    def dist(x):
        d = distances(x, centres)
        own = d.argmin(axis=1)
        inside = np.isin(own, sorted(large))
        return np.where(inside, d[np.arange(len(x)), own], distances(x, big).min(axis=1))

    return labelled.withColumn("raw_score", array_udf(dist, "double")(as_array(df, features))).drop("__c")


# ---------------------------------------------------------------- isolation forest


def _grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, int]]:
    """One isolation tree as rows (feature, threshold, left, right, size); feature -1 is a leaf."""
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list = []

    def build(rows, depth):
        me = len(nodes)
        nodes.append((-1, 0.0, -1, -1, len(rows)))
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        wide = np.flatnonzero(hi > lo)
        if depth < limit and len(rows) > 1 and len(wide):
            f = int(rng.choice(wide))
            t = float(rng.uniform(lo[f], hi[f]))
            below = rows[:, f] <= t
            a = build(rows[below], depth + 1)
            b = build(rows[~below], depth + 1)
            nodes[me] = (f, t, a, b, len(rows))
        return me

    build(x, 0)
    return nodes


def _mean_path(n):
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def isolation_forest(df: DataFrame, id_col: str, features: str = "features", trees: int = FOREST_TREES, sample: int = FOREST_SAMPLE) -> DataFrame:
    """Trees grow on executors from hash-chosen samples of 256 rows; rows are scored in Arrow batches."""
    n = df.count()
    share = min(1.0, 1.5 * sample / max(n, 1) + 20.0 / max(n, 1))
    draw = lambda t: F.pmod(F.xxhash64(col(id_col).cast("string"), t), F.lit(2**31)) / float(2**31)
    picks = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < share)
    marked = df.withColumn("__picks", picks)
    some = marked.select(col(id_col).alias("id"), as_array(df, features).alias("v"), F.explode("__picks").alias("tree"))
    w = Window.partitionBy("tree").orderBy(F.xxhash64(F.col("id").cast("string"), "tree"), "id")  # about 1.5 samples per tree
    chosen = some.withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample)

    def grow(pdf):
        t = int(pdf["tree"].iloc[0])
        nodes = _grow(stack(pdf.sort_values("r")["v"]), np.random.default_rng(SEED + t))
        out = pd.DataFrame(nodes, columns=["f", "t", "a", "b", "size"])
        out["tree"], out["node"] = t, range(len(nodes))
        return out

    schema = "f int, t double, a int, b int, size int, tree int, node int"
    rows = chosen.groupBy("tree").applyInPandas(grow, schema).orderBy("tree", "node").toPandas()  # trees x 2 x sample nodes
    forest = [g.to_numpy() for _, g in rows.groupby("tree")[["f", "t", "a", "b", "size"]]]
    norm = float(_mean_path(min(sample, n)))

    def score(x):
        total = np.zeros(len(x))
        for nodes in forest:
            f, t, a, b, size = nodes[:, 0].astype(int), nodes[:, 1], nodes[:, 2].astype(int), nodes[:, 3].astype(int), nodes[:, 4]
            at, depth = np.zeros(len(x), dtype=int), np.zeros(len(x))
            while True:
                live = f[at] >= 0
                if not live.any():
                    break
                go = np.flatnonzero(live)
                left = x[go, f[at[go]]] <= t[at[go]]
                at[go] = np.where(left, a[at[go]], b[at[go]])
                depth[go] += 1
            total += depth + _mean_path(size[at])
        return 2.0 ** (-(total / len(forest)) / (norm or 1.0))

    return df.withColumn("raw_score", array_udf(score, "double")(as_array(df, features)))


def loda(df: DataFrame, features: str = "features", cuts: int = LODA_CUTS, bins: int = LODA_BINS) -> DataFrame:
    """Mean -log density over random sparse projections, each with a ten-bin histogram."""
    p = df.select(F.size(as_array(df, features)).alias("n")).first()["n"]
    rng = np.random.default_rng(SEED)
    keep = max(1, int(math.sqrt(p)))
    w = np.zeros((p, cuts))
    for j in range(cuts):
        w[rng.permutation(p)[:keep], j] = rng.standard_normal(keep)
    column = [as_array(df, features).alias("v")]
    project = array_udf(lambda x: x @ w, "array<double>")
    ends = (
        df.select(F.posexplode(project(as_array(df, features))).alias("j", "x")).groupBy("j").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("j").collect()
    )
    lo, hi = np.array([r["lo"] for r in ends]), np.array([r["hi"] for r in ends])
    step = np.where(hi > lo, (hi - lo) / bins, 1.0)

    def slot(x):
        return np.clip(((x @ w - lo) / step).astype(int), 0, bins - 1)

    def count(pdf):
        ix = slot(stack(pdf["v"]))
        return {"h": np.stack([np.bincount(ix[:, j], minlength=bins) for j in range(cuts)])}

    h = sum_matrices(df, column, count)["h"]
    density = (h + 1e-12) / (h + 1e-12).sum(axis=1, keepdims=True)
    cost = -np.log(density)
    score = array_udf(lambda x: cost[np.arange(cuts), slot(x)].mean(axis=1), "double")
    return df.withColumn("raw_score", score(as_array(df, features)))


def mcd(df: DataFrame, id_col: str, features: str = "features", starts: int = 3, steps: int = 10) -> DataFrame:
    """Mahalanobis distance to a minimum covariance determinant estimate.

    Concentration steps: distances, the h nearest rows (an exact quantile, no sort), their mean and
    covariance from one aggregate; the start with the smallest determinant wins, then one reweighting.
    """
    base = df.select(col(id_col).alias("id"), as_array(df, features).alias("v")).persist()
    n, mean0, cov0 = moments(gram(base, "v")[""])
    p = len(mean0)
    h = (n + p + 1) // 2

    def distance(mean, inv):
        return array_udf(lambda x: np.einsum("ij,jk,ik->i", x - mean, inv, x - mean), "double")

    def inverse(cov):
        return np.linalg.pinv(cov)

    def step(mean, cov):
        d = base.withColumn("d", distance(mean, inverse(cov))("v")).persist()
        cut_at = exact_quantiles(d, ["d"], [(h - 1) / max(n - 1, 1)])["d"][0]
        _, m, c = moments(gram(d.where(F.col("d") <= cut_at), "v")[""])
        d.unpersist()
        return m, c, np.linalg.slogdet(c + 1e-12 * np.eye(p))[1]

    first = []
    for s in range(starts):  # two steps from every start, then only the best goes on
        mean, cov = mean0, cov0
        if s:
            u = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(SEED + s)), F.lit(2**31)) / float(2**31)
            _, mean, cov = moments(gram(base.where(u < max(0.05, min(1.0, 20.0 * (p + 1) / n))), "v")[""])
        for _ in range(2):
            mean, cov, logdet = step(mean, cov)
        first.append((logdet, s, mean, cov))
    last, _, mean, cov = min(first, key=lambda t: t[:2])
    for _ in range(steps):
        mean, cov, logdet = step(mean, cov)
        if last - logdet < 1e-6:
            break
        last = logdet
    d = base.withColumn("d", distance(mean, inverse(cov))("v"))
    med = exact_quantiles(d, ["d"], [0.5])["d"][0]
    chi_mid = p * (1 - 2 / (9 * p)) ** 3  # Wilson-Hilferty median and 97.5 % point of chi-square(p)
    chi_far = p * (1 - 2 / (9 * p) + 1.959963984540054 * math.sqrt(2 / (9 * p))) ** 3
    near = d.where(F.col("d") <= chi_far * (med / chi_mid if med > 0 else 1.0))
    _, mean, cov = moments(gram(near, "v")[""])
    return df.withColumn("raw_score", distance(mean, inverse(cov))(as_array(df, features)))


def raw_scores(df: DataFrame, model: str, id_col: str, features: str = "features") -> DataFrame:
    """Rows plus ``raw_score`` of one of MODELS."""
    assert model in MODELS, f"unknown detector; choose one of {MODELS}"
    if model == "Iforest":
        return isolation_forest(df, id_col, features)
    if model in ("KNN", "LOF", "MCD"):
        return {"KNN": knn_score, "LOF": lof, "MCD": mcd}[model](df, id_col, features)
    return {"CBLOF": cblof, "COPOD": copod, "ECOD": ecod, "HBOS": hbos, "LODA": loda, "PCA": pca_score}[model](df, features)


def scale_score(df: DataFrame, raw: str = "raw_score", out: str = "anomaly_score") -> DataFrame:
    """Min-max scaling of the score to [0, 1]; a constant score gives 0."""
    lo, hi = df.agg(F.min(raw), F.max(raw)).first()
    span = (hi - lo) if hi is not None and hi > lo else 1.0
    return df.withColumn(out, (F.col(raw) - F.lit(lo)) / F.lit(span)).drop(raw)


def anomaly_scores(df: DataFrame, model: str, id_col: str, features: str = "features") -> DataFrame:
    return scale_score(cut(raw_scores(df, model, id_col, features)))


def scores_and_preparation(df: DataFrame, model: str, id_col: str, imputation_numerical="mean", scaler="zscore", imputation_categorical="most_frequent") -> DataFrame:
    """Prepare the table (all but the id) and return (id, features, anomaly_score)."""
    from lakelens.operators.prep import data_preprocessing

    body = df.drop(id_col)
    fitted = data_preprocessing(body, None, None, imputation_numerical, scaler, imputation_categorical).fit(body)
    return anomaly_scores(cut(fitted.transform(df).select(col(id_col), "features")), model, id_col)


def reference_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(index, columns...): the rows median_all and mean_all."""
    q = exact_quantiles(df, columns, [0.5])
    m = df.agg(*[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    rows = [("median_all", *[q[c][0] for c in columns]), ("mean_all", *[m[f"m{i}"] for i in range(len(columns))])]
    return report(df.sparkSession, rows, "index string, " + ", ".join(f"`{c}` double" for c in columns))


def selected_cases(df: DataFrame, id_col: str, columns: list[str], threshold: float, score: str = "anomaly_score") -> DataFrame:
    """(index, variable, value): profile lines of the rows at or above the threshold and both references.

    The score itself is one of the lines, marked by its name.
    """
    names = [*columns, score]
    chosen = df.where(col(score) >= threshold).select(col(id_col).cast("string").alias("index"), *[number(df, c).alias(c) for c in names])
    return chosen.unionByName(reference_rows(df, names)).unpivot(["index"], [col(c) for c in names], "variable", "value")


def cross_validate_detectors(df: DataFrame, models: list[str], id_col: str, regressor=None, folds: int = 10, repeats: int = 5, preparation: dict | None = None) -> DataFrame:
    """(model, rep, fold, time, scores): detector scores of validation rows against a regression of the
    training rows' scores on the features. The detector is fitted on each part separately."""
    from pyspark.ml.regression import RandomForestRegressor

    from lakelens.operators.metrics import REGRESSION, regression_scores
    from lakelens.operators.prep import data_preprocessing
    from lakelens.operators.split import fold_parts, repeated_folds

    reg = regressor or RandomForestRegressor(seed=SEED, numTrees=20)
    base = cut(repeated_folds(df.dropDuplicates(), [id_col], folds, repeats))
    body = [c for c in df.columns if c != id_col]
    rows = []
    for name in models:
        for rep in range(1, repeats + 1):
            for fold in range(folds):
                start = time.time()
                train, val = fold_parts(base, f"fold_{rep}", fold)
                prep = data_preprocessing(train.select(body), **(preparation or {})).fit(train.select(body))
                tr = anomaly_scores(cut(prep.transform(train.select(id_col, *body)).select(id_col, "features")), name, id_col)
                va = anomaly_scores(cut(prep.transform(val.select(id_col, *body)).select(id_col, "features")), name, id_col)
                model = reg.copy({reg.featuresCol: "features", reg.labelCol: "anomaly_score", reg.predictionCol: "__p"}).fit(tr)
                s = regression_scores(model.transform(va), "anomaly_score", "__p").first()
                rows.append((name, rep, fold, time.time() - start, *[s[m] for m in REGRESSION]))
    return report(df.sparkSession, rows, "model string, rep int, fold int, time double, " + ", ".join(f"{m} double" for m in REGRESSION))
