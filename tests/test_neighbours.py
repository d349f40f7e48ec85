"""Neighbour joins, clustering and detectors against brute force on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakelens.operators import anomaly, cluster, knn


def cloud(spark, n=400, d=3, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    x = np.round(np.concatenate([rng.normal(c, 0.4, (n // 4, d)) for c in (0, 2, 4, 7)]), 2)
    if copies:
        x[:copies] = x[0]  # a group of equal vectors
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, features array<double>").repartition(5)
    return df, x


def brute(x, k, p=2):
    d = np.abs(x[:, None] - x[None]).sum(-1) if p == 1 else np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :k]
    return {(i, r + 1): int(j) for i, row in enumerate(order) for r, j in enumerate(row)}


@pytest.mark.parametrize("pivots,block,copies,p", [(1, 4096, 0, 2), (9, 50, 0, 2), (9, 40, 140, 2), (6, 64, 0, 1)])
def test_knn_join_is_exact(spark, pivots, block, copies, p):
    df, x = cloud(spark, copies=copies)
    got = {(r["id"], r["rank"]): r["neighbour"] for r in knn.knn_join(df, df, "id", "features", 6, p, pivots, block).collect()}
    assert got == brute(x, 6, p)


def test_radius_counts(spark):
    df, x = cloud(spark, copies=100)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = {r["id"]: r["n"] for r in knn.neighbour_counts(df, "id", "features", 0.5, pivots=7, block=50).collect()}
    assert got == {i: int(n) for i, n in enumerate((d <= 0.5).sum(1))}


def brute_dbscan(x, eps, m):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = d.sum(1) >= m
    label, k = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = k
            while todo:
                for j in np.flatnonzero(d[todo.pop()] & core & (label < 0)):
                    label[j] = k
                    todo.append(j)
            k += 1
    for i in np.flatnonzero(~core):
        near = label[d[i] & core]
        label[i] = near.min() if len(near) else -1
    return label


@pytest.mark.parametrize("eps,block", [(0.35, 40), (0.5, 500)])
def test_dbscan_is_exact(spark, eps, block):
    df, x = cloud(spark, copies=30)
    got = {r["id"]: r["cluster_label"] for r in cluster.dbscan(df, "id", eps=eps, min_samples=5, pivots=6, block=block).collect()}
    assert got == dict(enumerate(brute_dbscan(x, eps, 5).tolist()))


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, j) for j in range(6, 60)]
    got = {r["node"]: r["component"] for r in knn.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[n] for n in range(100, 161)} == {100} and {got[n] for n in range(5, 60)} == {5}


@pytest.mark.parametrize("name", ["KMeans", "AgglomerativeClustering_ward", "AgglomerativeClustering_average", "BIRCH", "GaussianMixture_tied", "GaussianMixture_diag"])
def test_models_find_separated_groups(spark, name):
    df, x = cloud(spark)
    labelled = cluster.fit_predict(df, name, 4, "id")
    truth = labelled.withColumn("truth", F.floor(F.col("id") / 100))
    assert cluster.agreement(truth, "truth", "cluster_label").first()["RandScore"] > 0.9


@pytest.mark.parametrize("block", [20_000, 40])
def test_summary_beyond_the_limit_merges_only_the_closest(spark, block):
    x = [[10.0 * i, float(i % 3)] for i in range(200)]
    df = spark.createDataFrame([(v,) for v in x + x[:50] + [[0.001, 0.0]]], "features array<double>")
    points, weights, reached = cluster.micro_clusters(df, "features", limit=201, block=block)
    assert reached == 0 and len(points) == 201 and weights.sum() == 251
    points, weights, reached = cluster.micro_clusters(df, "features", limit=200, block=block)
    assert 0 < reached < 0.001 and weights.sum() == 251  # before: k-means centres of all vectors
    assert sorted(map(tuple, points.tolist()))[1:] == sorted(map(tuple, x[1:])) and sorted(weights)[-1] == 3


def test_threshold_rises_no_further_than_the_limit_asks():
    x = np.random.default_rng(5).normal(size=(3000, 32))
    m, n, ss, reached = cluster._condense(((v, 1.0, 0.0, 0.5) for v in x), 100)
    assert len(m) == 100 and n.sum() == 3000 and np.sqrt(ss / n).max() <= reached + 1e-12
    assert np.allclose((n[:, None] * m).sum(axis=0), x.sum(axis=0))
    assert reached <= 1.1 * np.sqrt(x.var(axis=0).sum())  # steps of a half made one leaf of all


def test_birch_returns_the_threshold_it_ended_with(spark):
    df, x = cloud(spark)
    _, reached = cluster.birch(df, 4, threshold=1e6)
    assert reached == 1e6
    rows, reached = cluster.birch(df, 4, threshold=1e-4, limit=50)
    assert reached > 1e-4 and rows.count() == len(x)
    rows, reached = cluster.agglomerative(df, 4, "ward", limit=50)
    truth = rows.withColumn("truth", F.floor(F.col("id") / 100))
    assert reached > 0 and cluster.agreement(truth, "truth", "cluster_label").first()["RandScore"] > 0.9


def test_stop_rule_and_bad_names(spark):
    assert cluster.stalled([1, 2], 1) and not cluster.stalled([1, 2, 3], 2) and cluster.stalled([3, 2, 1], 3)
    assert cluster.stalled([1, 2, 3], 3, maximise=False) and not cluster.stalled([1], 2)
    with pytest.raises(AssertionError):
        cluster.fit_predict(cloud(spark)[0], "nope", 2, "id")


@pytest.mark.parametrize("name", anomaly.MODELS)
def test_detectors_rank_a_far_point_high(spark, name):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    x[7] = [9.0, 9.5, -9.0]
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, features array<double>")
    s = {r["id"]: r["anomaly_score"] for r in anomaly.anomaly_scores(df, name, "id").collect()}
    assert len(s) == 300 and min(s.values()) == 0 and max(s.values()) == pytest.approx(1)
    assert sorted(s, key=s.get)[-5:].count(7) == 1


def test_large_cluster_rule():
    assert anomaly.large_clusters([50, 45, 4, 1]) == 2
    assert anomaly.large_clusters([40, 30, 20, 10]) == 3


def test_pairwise_silhouette_has_a_limit(spark):
    df, _ = cloud(spark)
    with pytest.raises(ValueError):
        knn.silhouette_blocks(df.withColumn("g", F.lit("a")), "id", "features", "g", limit=10)


def test_pairwise_silhouette_has_no_limit_of_its_own(spark, monkeypatch):
    import inspect

    assert inspect.signature(knn.silhouette_blocks).parameters["limit"].default is None
    monkeypatch.setattr(knn, "BLOCK", 64)  # several blocks on each side
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(150, 3)) + 1e4, rng.normal(size=(60, 3)) + 1e4 + 3])
    x[1] = x[0]
    x[2] = x[0] + 1e-7
    g = np.array([0] * 150 + [1] * 60)
    df = spark.createDataFrame([(i, [float(a) for a in v], int(k)) for i, (v, k) in enumerate(zip(x, g))], "id long, features array<double>, g int")
    got = {r["id"]: r["s"] for r in knn.silhouette_blocks(df, "id", "features", "g").collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i in range(len(x)):
        a, b = d[i, g == g[i]].sum() / ((g == g[i]).sum() - 1), d[i, g != g[i]].mean()
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-7)


@pytest.mark.parametrize("p", [1, 2])
def test_blocks_keep_digits_and_ties_of_exact_distances(p, monkeypatch):
    from lakelens.operators import knn

    rng = np.random.default_rng(5)
    grid = rng.integers(0, 3, (300, 6)).astype(float)  # many equal distances
    spread, far = rng.normal(size=(300, 64)), rng.normal(size=(300, 9)) * 1e-6 + 1e6  # digits cancel in the last
    wide = rng.normal(size=(300, 4)) * 10.0 ** rng.integers(-40, 40, (300, 1))
    for x in (grid, spread, far, wide, np.zeros((40, 3))):
        left, right = x[: len(x) // 3], x
        exact = knn.distances(left, right, p)
        for eps in (0.0, 1.0, 3.0, float(exact[0, 7]), float(np.median(exact))):
            assert np.array_equal(knn.within(left, right, eps, p), exact <= eps)
        for k in (1, 5, len(right)):
            at, d = knn.nearest(left, right, k, p)
            want = np.argsort(exact, axis=1, kind="stable")[:, :k]
            assert np.array_equal(at, want) and np.array_equal(d, np.take_along_axis(exact, want, axis=1))
    calls = []
    pairs = knn.pair_distances
    monkeypatch.setattr(knn, "pair_distances", lambda x, y, i, j, p: calls.append(len(i)) or pairs(x, y, i, j, p))
    knn.within(spread, spread, 5.0 if p == 2 else 40.0, p)
    knn.nearest(spread, spread, 5, p)
    assert calls[0] < 0.01 * 300 * 300 and calls[1] < 6 * 300  # the others need no exact distance


@pytest.mark.parametrize("p", [1, 2])
def test_tiles_keep_the_nearest_of_all(p):
    rng = np.random.default_rng(6)
    grid = rng.integers(0, 3, (300, 6)).astype(float)  # many equal distances
    gaps = rng.normal(size=(300, 5))
    gaps[50] = np.nan
    for x in (grid, rng.normal(size=(300, 64)), rng.normal(size=(300, 9)) * 1e-6 + 1e6, gaps, np.zeros((40, 3))):
        for k in (1, 7, 40):
            at, d = knn.nearest_by_tiles(x[:100], x, k, p, 16)
            want, exact = knn.nearest(x[:100], x, k, p)
            assert np.array_equal(at, want) and np.array_equal(d, exact, equal_nan=True)


def test_rows_are_shuffled_to_few_blocks(spark):
    n, block = 3000, 50  # 60 blocks on each side before, so that every row was shuffled 60 times
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 4)).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<float>")
    rows = knn.vectors(df, "id", "features")
    assert dict(rows.dtypes)["v"] == "array<float>"  # doubles before
    queries = rows.select(F.col("id").alias("qid"), "v", F.lit(0).alias("cell"))

    def sizes(left, x, right, y):
        return pd.DataFrame({"l": [len(x)], "r": [len(y)]})

    got = knn.run_blocks(queries, rows, sizes, "l long, r long", 4, block=block).toPandas()
    assert (got["l"] * got["r"]).sum() == n * n
    assert got["l"].sum() + got["r"].sum() <= 2 * 6 * n
    many = np.zeros((20, 20)) + 0.1 * np.abs(np.subtract.outer(np.arange(20), np.arange(20)))
    of = knn._bundles(np.full(20, 10), many, 45)  # cells share bundles with their neighbours
    assert of.tolist() == [i // 4 for i in range(20)]
