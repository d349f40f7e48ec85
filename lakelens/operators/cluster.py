"""Cluster models, cluster scores, sweeps and prediction-based validation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans, PowerIterationClustering
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelens.functions.columns import col
from lakelens.operators.associations import corrected_v
from lakelens.operators.knn import RadiusBlocks, connected_components, count_within, distances, knn_join, vectors
from lakelens.operators.profile import report
from lakelens.plans.matrix import array_udf, as_array, gram, moments, stack, sum_matrices
from lakelens.plans.session import BROADCAST_VECTORS, cut, lookup

SEED = 123
MICRO = 1000  # micro-clusters that reach the driver-side linkage

# Model names.
MODELS = (
    "AgglomerativeClustering_average",
    "AgglomerativeClustering_complete",
    "AgglomerativeClustering_single",
    "AgglomerativeClustering_ward",
    "BayesianGaussianMixture_diag",
    "BayesianGaussianMixture_full",
    "BayesianGaussianMixture_spherical",
    "BayesianGaussianMixture_tied",
    "BIRCH",
    "DBSCAN",
    "GaussianMixture_diag",
    "GaussianMixture_full",
    "GaussianMixture_spherical",
    "GaussianMixture_tied",
    "KMeans",
    "SpectralClustering_nearest_neighbors",
    "SpectralClustering_rbf",
)
SCORES = ("Calinski-Harabasz", "Davies-Bouldin", "Silhouette", "min_freq")
AGREEMENT = ("CramersV", "Fowlkes-Mallows", "RandScore", "Completeness", "Homogeneity", "V-Measure")


def _as_vector(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("__vec", array_to_vector(as_array(df, features)))


def kmeans(df: DataFrame, k: int, features: str = "features", weight: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """(labelled rows, centres)."""
    est = KMeans(k=k, seed=SEED, featuresCol="__vec", predictionCol="cluster_label")
    if weight:
        est = est.setWeightCol(weight)
    v = _as_vector(df, features)
    model = est.fit(v)
    return model.transform(v).drop("__vec"), np.array([list(c) for c in model.clusterCenters()])


def gaussian_mixture_full(df: DataFrame, k: int, features: str = "features") -> DataFrame:
    v = _as_vector(df, features)
    model = GaussianMixture(k=k, seed=SEED, featuresCol="__vec", predictionCol="cluster_label", probabilityCol="__prob").fit(v)
    return model.transform(v).drop("__vec", "__prob")


# ---------------------------------------------------------------- mixtures by distributed EM


def _log_gauss(x, means, covs):
    """log N(x | mean_k, cov_k) per component; covs has full p x p matrices."""
    out = np.empty((len(x), len(means)))
    for j, (m, c) in enumerate(zip(means, covs)):
        low = np.linalg.cholesky(c)
        z = np.linalg.solve(low, (x - m).T)
        out[:, j] = -0.5 * (x.shape[1] * math.log(2 * math.pi) + (z**2).sum(axis=0)) - np.log(np.diag(low)).sum()
    return out


def _shape_cov(kind, s, nk, reg=1e-6):
    """Covariances of one type from per-component scatter matrices (already centred)."""
    k, p = len(nk), s.shape[1]
    if kind == "tied":
        c = s.sum(axis=0) / nk.sum()
        return np.repeat((c + reg * np.eye(p))[None], k, axis=0)
    c = s / nk[:, None, None]
    if kind == "full":
        return c + reg * np.eye(p)
    d = np.einsum("kii->ki", c) + reg
    if kind == "spherical":
        d = np.repeat(d.mean(axis=1, keepdims=True), p, axis=1)
    return np.array([np.diag(row) for row in d])


def _digamma(x):
    x, r = np.asarray(x, float).copy(), 0.0
    r = np.zeros_like(x)
    while np.any(x < 6):
        small = x < 6
        r = r - np.where(small, 1.0 / x, 0.0)
        x = np.where(small, x + 1, x)
    f = 1.0 / (x * x)
    return r + np.log(x) - 0.5 / x - f * (1 / 12.0 - f * (1 / 120.0 - f / 252.0))


def mixture(df: DataFrame, k: int, kind: str, features: str = "features", bayesian: bool = False, max_iter: int = 30, tol: float = 1e-3) -> tuple[DataFrame, dict]:
    """Gaussian mixture by EM: each iteration is one pass that adds up responsibilities per component.

    ``bayesian`` puts a Dirichlet-process prior on the weights and a Gaussian-Wishart prior on the
    components (prior mean = data mean, prior covariance = data covariance), updated variationally.
    """
    _, centres = kmeans(df, k, features)
    g = gram(df, features)[""]
    n, mean0, cov0 = moments(g)
    p = len(mean0)
    prior_cov = cov0 * n / max(n - 1, 1)
    a0, b0, nu0 = 1.0 / k, 1.0, float(p)
    column = [as_array(df, features).alias("v")]

    def accumulate(log_resp):
        def fn(pdf):
            x = stack(pdf["v"])
            lr = log_resp(x)
            top = lr.max(axis=1, keepdims=True)
            norm = top[:, 0] + np.log(np.exp(lr - top).sum(axis=1))
            r = np.exp(lr - norm[:, None])
            return {"n": r.sum(axis=0), "x": r.T @ x, "xx": np.einsum("nk,ni,nj->kij", r, x, x), "ll": np.array([norm.sum()])}

        return sum_matrices(df, column, fn)

    def from_centres(x):
        d = distances(x, centres)
        return np.where(d == d.min(axis=1, keepdims=True), 0.0, -1e9)

    state, last, log_resp = None, -math.inf, from_centres
    for it in range(max_iter):
        s = accumulate(log_resp)
        nk = s["n"] + 10 * np.finfo(float).eps
        xbar = s["x"] / nk[:, None]
        scatter = s["xx"] - nk[:, None, None] * np.einsum("ki,kj->kij", xbar, xbar)
        if not bayesian:
            covs = _shape_cov(kind, scatter, nk)
            log_w = np.log(nk / n)
            means = xbar

            def log_resp(x, means=means, covs=covs, log_w=log_w):
                return _log_gauss(x, means, covs) + log_w

        else:
            beta = b0 + nk
            means = (b0 * mean0 + nk[:, None] * xbar) / beta[:, None]
            off = xbar - mean0
            extra = (b0 * nk / beta)[:, None, None] * np.einsum("ki,kj->kij", off, off)
            if kind == "tied":
                nu = np.full(k, nu0 + n / k)
                one = (prior_cov + (scatter + extra).sum(axis=0) / k) / nu[0]
                covs = np.repeat((one + 1e-6 * np.eye(p))[None], k, axis=0)
            else:
                nu = nu0 + nk
                full = (prior_cov[None] + scatter + extra) / nu[:, None, None]
                covs = _shape_cov(kind, full * nk[:, None, None], nk)
            tail = np.hstack([np.cumsum(nk[::-1])[-2::-1], 0.0])
            ga, gb = 1.0 + nk, a0 + tail
            dg = _digamma(ga + gb)
            log_w = _digamma(ga) - dg + np.hstack([0.0, np.cumsum(_digamma(gb) - dg)[:-1]])
            corr = 0.5 * (p * math.log(2.0) + _digamma(0.5 * (nu[None, :] - np.arange(p)[:, None])).sum(axis=0) - p * np.log(nu) - p / beta)

            def log_resp(x, means=means, covs=covs, shift=log_w + corr):
                return _log_gauss(x, means, covs) + shift

        state = {"weights": nk / n, "means": means, "covariances": covs}
        ll = float(s["ll"][0]) / n
        if it > 1 and abs(ll - last) < tol:
            break
        last = ll
    state["log_likelihood"] = last
    label = array_udf(lambda x: log_resp(x).argmax(axis=1).astype("int32"), "int")
    return df.withColumn("cluster_label", label(as_array(df, features))), state


# ---------------------------------------------------------------- hierarchies over micro-clusters


def linkage_labels(points: np.ndarray, weights: np.ndarray, k: int, method: str) -> np.ndarray:
    """Agglomerate a summary of weighted points into k groups (Lance-Williams updates)."""
    m = len(points)
    if m <= k:
        return np.arange(m)
    d = distances(points, points)
    w = weights.astype(float).copy()
    if method == "ward":
        d = d**2 * (w[:, None] * w[None, :]) / (w[:, None] + w[None, :])
    np.fill_diagonal(d, np.inf)
    parent = np.arange(m)
    for _ in range(m - k):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = min(i, j), max(i, j)
        if method == "single":
            row = np.minimum(d[i], d[j])
        elif method == "complete":
            row = np.where(np.isinf(d[i]) | np.isinf(d[j]), np.inf, np.maximum(d[i], d[j]))
        elif method == "average":
            row = (w[i] * d[i] + w[j] * d[j]) / (w[i] + w[j])
        else:
            row = ((w[i] + w) * d[i] + (w[j] + w) * d[j] - w * d[i, j]) / (w[i] + w[j] + w)
        d[i, :], d[:, i] = row, row
        d[i, i] = np.inf
        d[j, :], d[:, j] = np.inf, np.inf
        w[i] += w[j]
        parent[parent == j] = i
    _, labels = np.unique(parent, return_inverse=True)
    return labels


def _label_nearest(df: DataFrame, features: str, points: np.ndarray, labels: np.ndarray) -> DataFrame:
    nearest = array_udf(lambda x: labels[distances(x, points).argmin(axis=1)].astype("int32"), "int")
    return df.withColumn("cluster_label", nearest(as_array(df, features)))


def _merge_closest(cm, cn, cs, threshold, limit):
    """Merge neighbouring leaves, those of the smallest merged radius first, until ``limit`` are left; (leaves..., largest radius used)."""
    while len(cm) > limit:
        x = cm - cm.mean(axis=0)
        d = (x**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :] - 2 * x @ x.T
        np.fill_diagonal(d, np.inf)
        j = d.argmin(axis=1)
        tot = cn + cn[j]
        merged = cs + cs[j] + cn * cn[j] / tot * ((cm - cm[j]) ** 2).sum(axis=1)
        radius = np.sqrt(merged / tot)
        gone, used, spare = np.zeros(len(cm), bool), np.zeros(len(cm), bool), len(cm) - limit
        cm, cs = cm.copy(), cs.copy()
        for a in np.argsort(radius, kind="stable"):
            b = j[a]
            if used[a] or used[b]:
                continue
            cm[a] += (cm[b] - cm[a]) * (cn[b] / tot[a])
            cs[a], used[a], used[b], gone[b] = merged[a], True, True, True
            threshold = max(threshold, float(radius[a]))
            spare -= 1
            if not spare:
                break
        cn = np.where(used & ~gone, tot, cn)
        cm, cn, cs = cm[~gone], cn[~gone], cs[~gone]
    return cm, cn, cs, threshold


def _condense(rows, limit):
    """Sequential clustering features of rows (mean, weight, squares about the mean, least threshold): a row joins its nearest leaf when the merged radius stays within the threshold.

    Twice ``limit`` leaves are merged down to ``limit``, closest first, and the threshold becomes the largest
    radius that this made; so it rises no further than the limit asks for.
    """
    room = 2 * limit
    cm, cn, cs = np.empty((0, 0)), np.empty(room), np.empty(room)
    size, threshold = 0, 0.0
    for x, w, q, least in rows:
        if not size:
            cm = np.empty((room, len(x)))
        threshold = max(threshold, least)
        if size:
            d = ((cm[:size] - x) ** 2).sum(axis=1)
            j = int(d.argmin())
            tot = cn[j] + w
            merged = cs[j] + q + cn[j] * w / tot * d[j]
            if math.sqrt(merged / tot) <= threshold:
                cm[j] += (x - cm[j]) * (w / tot)
                cn[j], cs[j] = tot, merged
                continue
        if size == room:
            a, b, c, threshold = _merge_closest(cm, cn, cs, threshold, limit)
            size = len(a)
            cm[:size], cn[:size], cs[:size] = a, b, c
        cm[size], cn[size], cs[size] = x, w, q
        size += 1
    return _merge_closest(cm[:size], cn[:size], cs[:size], threshold, limit)


def micro_clusters(df: DataFrame, features: str, limit: int = MICRO, threshold: float = 0.0, block: int = 20_000) -> tuple[np.ndarray, np.ndarray, float]:
    """(centres, weights, threshold reached): at most ``limit`` clustering features of the distinct vectors.

    One rule at every size: executors condense blocks of about ``block`` vectors, then 16 blocks of leaves at a
    time, and only the last leaves reach the driver. The radius of a leaf is at most the threshold reached,
    which starts at ``threshold`` and rises only as far as ``limit`` asks for. A threshold of 0 leaves every distinct vector
    a leaf of its own, so a result with threshold 0 is exact.
    """

    def summarise(batches):
        each = (row for pdf in batches for row in zip(pdf["v"], pdf["n"], pdf["ss"], pdf["reached"]))
        mean, n, ss, reached = _condense(each, limit)
        if len(mean):
            yield pd.DataFrame({"v": list(mean), "n": n, "ss": ss, "reached": reached})

    v = df.select(as_array(df, features).alias("v")).groupBy("v").agg(F.count("*").cast("double").alias("n"))
    leaves = cut(v.withColumns({"ss": F.lit(0.0), "reached": F.lit(float(threshold))}))
    parts = max(1, math.ceil(leaves.count() / block))
    while True:
        # the order within a task is that of the vectors, so the result does not depend on how rows were dealt
        dealt = leaves.repartition(parts, F.xxhash64("v")) if parts > 1 else leaves.repartition(1)
        leaves = cut(dealt.sortWithinPartitions(F.xxhash64("v", F.lit(1)), "v").mapInPandas(summarise, "v array<double>, n double, ss double, reached double"))
        if parts == 1:
            break
        parts = math.ceil(parts / 16)
    rows = sorted(leaves.collect(), key=lambda r: list(r["v"]))  # at most `limit` leaves
    return np.array([r["v"] for r in rows]), np.array([r["n"] for r in rows]), max((r["reached"] for r in rows), default=float(threshold))


def agglomerative(df: DataFrame, k: int, method: str, features: str = "features", limit: int = MICRO) -> tuple[DataFrame, float]:
    """(labelled rows, radius within which vectors were merged first): linkage of at most ``limit`` micro-clusters; exact where the radius is 0."""
    points, weights, reached = micro_clusters(df, features, limit)
    return _label_nearest(df, features, points, linkage_labels(points, weights, k, method)), reached


def birch(df: DataFrame, k: int, features: str = "features", threshold: float = 0.5, limit: int = 500) -> tuple[DataFrame, float]:
    """(labelled rows, threshold reached): Ward linkage of clustering features.

    ``limit`` is the most leaves that the tree may have; where ``threshold`` gives more, it is raised, and the result says to what.
    """
    points, weights, reached = micro_clusters(df, features, limit, threshold)
    return _label_nearest(df, features, points, linkage_labels(points, weights, k, "ward")), reached


# ---------------------------------------------------------------- density and graph clustering


def dbscan(df: DataFrame, id_col: str, features: str = "features", eps: float = 0.5, min_samples: int = 5, pivots: int | None = None, block: int = 2048) -> DataFrame:
    """Exact DBSCAN: (row..., cluster_label), noise -1, border points go to the smallest cluster.

    Copies of a vector are one node with a weight. Blocks return neighbour counts, then for core nodes
    spanning forests (at most as many edges as rows for each tile of queries, not all pairs), whose union has the same
    components as the full graph; last, border nodes take the smallest label within eps.
    """
    rows = cut(vectors(df, id_col, features))
    distinct = cut(rows.groupBy("v").agg(F.min("id").alias("qid"), F.count("*").alias("m")))
    rb = RadiusBlocks(distinct, eps, 2, pivots, block)
    idt = dict(distinct.dtypes)["qid"]

    n = rb.run(rb.rows, rb.rows, count_within, f"qid {idt}, n long").groupBy("qid").agg(F.sum("n").alias("n"))
    core_ids = n.where(F.col("n") >= min_samples).select("qid")
    core = cut(rb.rows.join(core_ids, "qid"))

    def forest(left, right, walk):
        nodes, inv = np.unique(np.concatenate([left["qid"].to_numpy(), right["id"].to_numpy()]), return_inverse=True)
        li, ri = inv[: len(left)], inv[len(left):]
        parent, edges = np.arange(len(nodes)), []

        def roots(at):
            r = parent[at]
            while (parent[r] != r).any():
                r = parent[r]
            parent[at] = r
            return r

        for u, near in walk():
            for a, row in zip(li, near):
                hit = ri[u][row]
                other, first = np.unique(roots(hit), return_index=True)
                own = roots(np.array([a]))[0]
                first, other = first[other != own], other[other != own]
                edges += [(nodes[a], nodes[h]) for h in hit[first]]
                parent[other] = own
        return pd.DataFrame(edges, columns=["a", "b"])

    edges = rb.run(core, core, forest, f"a {idt}, b {idt}")
    comp = connected_components(cut(edges.unionByName(core.select(F.col("qid").alias("a"), F.col("qid").alias("b")))))
    roots = comp.select("component").distinct()
    ordered = running_labels(roots)
    labelled = cut(core.join(comp.join(ordered, "component").select(F.col("node").alias("qid"), "label"), "qid"))

    def touch(left, right, walk):
        none, label = np.iinfo("int32").max, right["label"].to_numpy()
        lab = np.min([np.where(near, label[u], none).min(axis=1) for u, near in walk()], axis=0)
        return pd.DataFrame({"qid": left["qid"].to_numpy(), "label": lab})[lab < none]

    border = rb.rows.join(core_ids, "qid", "left_anti")
    edge_labels = rb.run(border, labelled.select("qid", "v", "cell", "dp", "label"), touch, f"qid {idt}, label int").groupBy("qid").agg(F.min("label").alias("label"))
    all_labels = labelled.select("qid", "label").unionByName(edge_labels)
    table = distinct.join(all_labels, "qid", "left").select("v", "m", F.coalesce("label", F.lit(-1)).alias("cluster_label"))
    marks = lookup(rows, cut(table), "v", "m", BROADCAST_VECTORS).select(F.col("id").alias(id_col), "cluster_label")
    return df.join(marks, id_col)


def running_labels(roots: DataFrame) -> DataFrame:
    """Number cluster roots 0.. in id order."""
    from lakelens.plans.ranking import running_totals

    c = running_totals(roots.withColumn("one", F.lit(1)), "component", ["one"])
    return c.select("component", (F.col("one_cum") - 1).cast("int").alias("label"))


def spectral(df: DataFrame, k: int, id_col: str, affinity: str = "nearest_neighbors", features: str = "features", neighbours: int = 10, gamma: float = 1.0) -> DataFrame:
    """Power iteration clustering of the nearest-neighbour graph (weights 1 or exp(-gamma d^2))."""
    near = knn_join(df, df, id_col, features, neighbours)
    w = F.lit(1.0) if affinity == "nearest_neighbors" else F.greatest(F.exp(-gamma * F.col("distance") * F.col("distance")), F.lit(1e-12))
    edges = (
        near.select(F.least(col(id_col), F.col("neighbour")).alias("src"), F.greatest(col(id_col), F.col("neighbour")).alias("dst"), w.alias("weight"))
        .groupBy("src", "dst")
        .agg(F.max("weight").alias("weight"))
    )
    got = PowerIterationClustering(k=k, maxIter=20, initMode="degree", weightCol="weight").assignClusters(cut(edges))
    return df.join(got.select(F.col("id").alias(id_col), F.col("cluster").alias("cluster_label")), id_col)


def fit_predict(df: DataFrame, name: str, k: int | None, id_col: str, features: str = "features", weight: str | None = None) -> DataFrame:
    """Add ``cluster_label`` with one of MODELS."""
    assert name in MODELS, f"unknown cluster model; choose one of {MODELS}"
    kind = name.split("_", 1)[-1]
    if name == "KMeans":
        return kmeans(df, k, features, weight)[0]
    if name == "GaussianMixture_full":
        return gaussian_mixture_full(df, k, features)
    if name.startswith("GaussianMixture"):
        return mixture(df, k, kind, features)[0]
    if name.startswith("BayesianGaussianMixture"):
        return mixture(df, k, kind, features, bayesian=True)[0]
    if name.startswith("Agglomerative"):
        return agglomerative(df, k, kind, features)[0]
    if name == "BIRCH":
        return birch(df, k, features)[0]
    if name == "DBSCAN":
        return dbscan(df, id_col, features)
    return spectral(df, k, id_col, kind, features)


# ---------------------------------------------------------------- scores


def _centroids(df: DataFrame, features: str, label: str) -> dict[str, tuple[float, np.ndarray, float]]:
    """label -> (n, centroid, within sum of squares), one pass."""
    out = {}
    for g, m in gram(df.withColumn("__l", col(label).cast("string")), features, by="__l").items():
        n, mean, cov = moments(m)
        out[g] = (n, mean, max(float(np.trace(cov)) * n, 0.0))
    return out


def cluster_scores(df: DataFrame, features: str = "features", label: str = "cluster_label", exact_id: str | None = None) -> dict[str, float | None]:
    """Calinski-Harabasz, Davies-Bouldin, Silhouette and the smallest share; undefined ones are None.

    Silhouette is the squared-distance form (linear in n), or the pairwise one when ``exact_id`` is given.
    """
    c = _centroids(df, features, label)
    n = sum(v[0] for v in c.values())
    k = len(c)
    out: dict[str, float | None] = dict.fromkeys(SCORES)
    out["min_freq"] = min(v[0] for v in c.values()) / n if c else None
    if not 2 <= k < n:
        return out
    names = sorted(c)
    mean = sum(c[g][0] * c[g][1] for g in names) / n
    between = sum(c[g][0] * float(((c[g][1] - mean) ** 2).sum()) for g in names)
    within = sum(c[g][2] for g in names)
    out["Calinski-Harabasz"] = (between / (k - 1)) / (within / (n - k)) if within > 0 else 1.0
    centres = np.array([c[g][1] for g in names])
    index = {g: i for i, g in enumerate(names)}

    def spread(pdf):
        x, ix = stack(pdf["v"]), pdf["g"].map(index).to_numpy()
        d = np.sqrt(((x - centres[ix]) ** 2).sum(axis=1))
        return {"d": np.bincount(ix, weights=d, minlength=k)}

    s = sum_matrices(df, [as_array(df, features).alias("v"), col(label).cast("string").alias("g")], spread)["d"]
    s = s / np.array([c[g][0] for g in names])
    gap = distances(centres, centres)
    if np.allclose(s, 0) or np.allclose(gap, 0):
        out["Davies-Bouldin"] = 0.0
    else:
        gap[gap == 0] = np.inf
        out["Davies-Bouldin"] = float(((s[:, None] + s[None, :]) / gap).max(axis=1).mean())
    if exact_id:
        from lakelens.operators.knn import silhouette_blocks

        out["Silhouette"] = silhouette_blocks(df, exact_id, features, label).agg(F.avg("s")).first()[0]
    else:
        out["Silhouette"] = silhouette(df, features, label).agg(F.avg("s")).first()[0]
    return out


def silhouette(df: DataFrame, features: str = "features", label: str = "cluster_label") -> DataFrame:
    """Rows plus ``s``, the squared-Euclidean silhouette from cluster sizes, sums and squared norms."""
    c = _centroids(df, features, label)
    names = sorted(c)
    size = np.array([c[g][0] for g in names])
    centres = np.array([c[g][1] for g in names])
    inner = np.array([c[g][2] for g in names]) / size
    index = {g: i for i, g in enumerate(names)}

    @F.pandas_udf("double")
    def score(v: pd.Series, g: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        x, own = stack(v), g.map(index).to_numpy()
        d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2) + inner[None]
        rows = np.arange(len(x))
        a = d[rows, own] * size[own] / np.maximum(size[own] - 1, 1)
        d[rows, own] = np.inf
        b = d.min(axis=1)
        s = np.where(np.maximum(a, b) > 0, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
        return pd.Series(np.where(size[own] == 1, 0.0, s))

    return df.withColumn("s", score(as_array(df, features), col(label).cast("string")))


def silhouette_table(scored: DataFrame, label: str = "cluster_label") -> DataFrame:
    """(cluster, position, s): silhouettes in ascending order within each cluster, with the overall mean.

    Positions come from range-wise running totals, so a cluster with most of the rows is not one task.
    """
    from lakelens.plans.ranking import running_totals

    counts = scored.groupBy(col(label).alias("cluster"), F.col("s")).agg(F.count("*").alias("n"))
    mean = scored.agg(F.avg("s")).first()[0]
    cum = running_totals(counts, "s", ["n"], by=["cluster"])
    return cum.select("cluster", "s", "n", (F.col("n_cum") - F.col("n") + 1).alias("position"), F.lit(mean).alias("mean_s"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row with the contingency-based agreement scores of two labelings."""
    cells = df.groupBy(col(a).cast("string").alias("a"), col(b).cast("string").alias("b")).agg(F.count("*").cast("double").alias("n")).persist()
    na = cells.groupBy("a").agg(F.sum("n").alias("na"))
    nb = cells.groupBy("b").agg(F.sum("n").alias("nb"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    j = cells.join(na, "a").join(nb, "b").agg(
        F.sum("n").alias("n"),
        F.sum(pairs).alias("tk"),
        F.sum(F.col("n") * F.ln(F.col("n") / F.col("nb"))).alias("hab"),
        F.sum(F.col("n") * F.ln(F.col("n") / F.col("na"))).alias("hba"),
        F.sum(F.col("n") / F.col("na") * (F.col("n") / F.col("nb"))).alias("q"),
    )
    ra = na.agg(F.count("*").cast("double").alias("r"), F.sum(F.col("na") * (F.col("na") - 1) / 2).alias("pa"), F.sum(F.col("na") * F.ln("na")).alias("ea"), F.lit(1).alias("one"))
    rb = nb.agg(F.count("*").cast("double").alias("k"), F.sum(F.col("nb") * (F.col("nb") - 1) / 2).alias("pb"), F.sum(F.col("nb") * F.ln("nb")).alias("eb"), F.lit(1).alias("one"))
    t = j.withColumn("one", F.lit(1)).join(ra, "one").join(rb, "one")
    n = F.col("n")
    ha, hb = F.ln(n) - F.col("ea") / n, F.ln(n) - F.col("eb") / n
    homogeneity = F.when(ha <= 1e-15, 1.0).otherwise(1 + F.col("hab") / n / ha)
    completeness = F.when(hb <= 1e-15, 1.0).otherwise(1 + F.col("hba") / n / hb)
    t = t.withColumns({"h": homogeneity, "c": completeness})
    total = n * (n - 1) / 2
    return t.select(
        corrected_v(n, F.col("r"), F.col("k"), F.greatest(n * (F.col("q") - 1), F.lit(0.0))).alias("CramersV"),
        F.when(F.col("tk") > 0, F.col("tk") / F.sqrt(F.col("pa") * F.col("pb"))).otherwise(0.0).alias("Fowlkes-Mallows"),
        F.coalesce(F.try_divide(total + 2 * F.col("tk") - F.col("pa") - F.col("pb"), total), F.lit(1.0)).alias("RandScore"),
        F.col("c").alias("Completeness"),
        F.col("h").alias("Homogeneity"),
        F.when(F.col("h") + F.col("c") > 0, 2 * F.col("h") * F.col("c") / (F.col("h") + F.col("c"))).otherwise(0.0).alias("V-Measure"),
    )


def bic(df: DataFrame, features: str = "features", label: str = "cluster_label") -> float:
    """Bayesian information criterion of a hard clustering with spherical clusters."""
    c = _centroids(df, features, label)
    n = sum(v[0] for v in c.values())
    p = len(next(iter(c.values()))[1])
    parameters = (len(c) - 1) + p * len(c) + 1
    ll = 0.0
    for m, _, sse in c.values():
        ll += m * math.log(m) - m * math.log(n) - m * p / 2 * math.log(2 * math.pi * sse / (m - 1)) - (m - 1) / 2
    return ll - parameters / 2 * math.log(n)


def min_frequency(df: DataFrame, label: str) -> DataFrame:
    """(label, n, freq) and through min(freq) the smallest share."""
    n = df.count()
    return df.groupBy(col(label).alias("label")).agg(F.count("*").alias("n"), (F.count("*") / F.lit(n)).alias("freq"))


def stalled(values: list[float], patience: int, maximise: bool = True) -> bool:
    """True when none of the last ``patience`` values improves on its predecessor (patience 1: at once)."""
    if len(values) < patience:
        return False
    steps = [(values[-i], values[-i - 1]) for i in range(1, patience)]
    return not any(new > old if maximise else new < old for new, old in steps)


# ---------------------------------------------------------------- sweeps


def sweep(
    df: DataFrame,
    models: list[str],
    k_min: int,
    k_max: int,
    id_col: str,
    features: str = "features",
    bootstraps: int = 0,
    patience_bootstrap: int | None = None,
    patience_k: int | None = None,
    monitor: str = "Silhouette",
) -> DataFrame:
    """(model, n_clusters, replicate, scores): models x k x bootstrap replicates with stop rules.

    Each fit and score is a Spark job over the persisted rows; a replicate repeats a row by its Poisson
    weight. Every 50 replicates the coefficient of variation of the monitored score is checked.
    """
    from lakelens.operators.split import bootstrap_weights

    base = df.persist()
    rows = []
    for name in models:
        trail = []
        for k in [None] if name == "DBSCAN" else range(k_min, k_max + 1):
            values, spread = [], []
            for rep in range(0, 1) if bootstraps == 0 else range(1, bootstraps + 1):
                data, key = base, id_col
                if rep:
                    w = bootstrap_weights(base, [id_col], rep, "__w").where("__w > 0")
                    data = w.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__w")))).withColumn("__id", F.xxhash64(col(id_col), "__copy"))
                    key = "__id"
                labelled = cut(fit_predict(data, name, k, key, features))
                s = cluster_scores(labelled, features)
                found = labelled.select("cluster_label").distinct().count()
                rows.append((name, int(k or found), rep, *[s[m] for m in SCORES]))
                values.append(s[monitor])
                if patience_bootstrap and rep and rep % 50 == 0:
                    known = np.array([v for v in values if v is not None])
                    spread.append(abs(known.std() / known.mean()) if len(known) and known.mean() else math.inf)
                    if stalled(spread, patience_bootstrap, maximise=False):
                        break
            known = [v for v in values if v is not None]
            trail.append(sum(known) / len(known) if known else -math.inf)
            if patience_k and stalled(trail, patience_k, monitor != "Davies-Bouldin"):
                break
    schema = "model string, n_clusters int, replicate int, " + ", ".join(f"`{m}` double" for m in SCORES)
    return report(df.sparkSession, rows, schema)


def prediction_strength(
    df: DataFrame, models: list[str], k_min: int, k_max: int, id_col: str, folds: int = 10, repeats: int = 5, features: str = "features", classifier=None,
    patience_k: int | None = None, monitor: str = "Silhouette",
) -> DataFrame:
    """(model, n_clusters, rep, fold, scores, agreement): clusters found on validation rows against those
    predicted by a classifier trained on the clusters of the training rows."""
    from pyspark.ml.classification import RandomForestClassifier

    from lakelens.operators.split import fold_parts, repeated_folds

    assert "DBSCAN" not in models, "the number of clusters of DBSCAN cannot be preassigned"
    base = repeated_folds(df, [id_col], folds, repeats)
    base = base.withColumn("__inputs", array_to_vector(as_array(base, features))).persist()
    clf = classifier or RandomForestClassifier(seed=SEED, numTrees=20)
    rows = []
    for name in models:
        trail = []
        for k in range(k_min, k_max + 1):
            values = []
            for rep in range(1, repeats + 1):
                for fold in range(folds):
                    train, val = fold_parts(base, f"fold_{rep}", fold)
                    tr = cut(fit_predict(train, name, k, id_col, features))
                    va = cut(fit_predict(val, name, k, id_col, features))
                    data = tr.withColumn("__y", F.col("cluster_label").cast("double"))
                    model = clf.copy({clf.featuresCol: "__inputs", clf.labelCol: "__y", clf.predictionCol: "__p"}).fit(data)
                    s = cluster_scores(tr, features)
                    a = agreement(model.transform(va), "cluster_label", "__p").first()
                    rows.append((name, k, rep, fold, *[s[m] for m in SCORES], *[a[m] for m in AGREEMENT]))
                    values.append(s[monitor] if monitor in s else a[monitor])
            known = [v for v in values if v is not None]
            trail.append(sum(known) / len(known) if known else -math.inf)
            if patience_k and stalled(trail, patience_k, monitor != "Davies-Bouldin"):
                break
    schema = "model string, n_clusters int, rep int, fold int, " + ", ".join(f"`{m}` double" for m in SCORES + AGREEMENT)
    return report(df.sparkSession, rows, schema)


def labels_and_preparation(df: DataFrame, model: str, k: int | None, id_col: str, imputation_numerical="mean", scaler="zscore", imputation_categorical="most_frequent") -> DataFrame:
    """Prepare the table (all but the id), fit the chosen model and return (id, features, cluster_label)."""
    from lakelens.operators.prep import data_preprocessing

    body = df.drop(id_col)
    fitted = data_preprocessing(body, None, None, imputation_numerical, scaler, imputation_categorical).fit(body)
    ready = cut(fitted.transform(df).select(col(id_col), "features"))
    return fit_predict(ready, model, k, id_col)
