"""Neighbour joins, clustering, cluster scores and anomaly detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakelens.functions.columns import col, r
from lakelens.operators import anomaly, charts, cluster, knn, reshape
from lakelens.operators.profile import report
from lakelens.registry.base import query
from lakelens.sources.io import table

DIST = "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
NEAR = f"""nn AS (SELECT a.vec_id, b.vec_id AS neighbour, {DIST} AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.vec_id) AS rank
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"""


def _union(parts):
    return " UNION ALL ".join(parts)


def emb(spark, d):
    return table(spark, d, "embeddings")


def round_all(df, digits=6):
    kinds = dict(df.dtypes)
    return df.select([r(col(c), digits).alias(c) if kinds[c] == "double" else col(c) for c in df.columns])


@query("j3_knn_join", f"WITH {NEAR} SELECT vec_id, neighbour, rank::INTEGER AS rank, round(distance, 6) AS distance FROM nn WHERE rank <= 10")
def _(spark, d):
    e = emb(spark, d)
    return round_all(knn.knn_join(e, e, "vec_id", "embedding", 10))


@query(
    "j3_knn_join_manhattan",
    """WITH p AS (SELECT a.vec_id, b.vec_id AS neighbour, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) AS distance
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM p)
SELECT vec_id, neighbour, rank::INTEGER AS rank, round(distance, 6) AS distance FROM n WHERE rank <= 5""",
)
def _(spark, d):
    e = emb(spark, d)
    return round_all(knn.knn_join(e, e, "vec_id", "embedding", 5, p=1, pivots=8))


EPS = 0.9


@query("j4_radius_counts", f"SELECT a.vec_id, count(*) AS n FROM embeddings a JOIN embeddings b ON {DIST} <= {EPS} GROUP BY 1")
def _(spark, d):
    return knn.neighbour_counts(emb(spark, d), "vec_id", "embedding", EPS, pivots=8)


def _folds(spark, d):
    from lakelens.operators.split import fold_parts, k_folds

    return fold_parts(k_folds(emb(spark, d), ["vec_id"], 5), "fold", 0)


_KF = """e AS (SELECT *, (row_number() OVER (ORDER BY md5(concat_ws('|', vec_id, '123')), vec_id) - 1) % 5 AS fold FROM embeddings),
n AS (SELECT a.vec_id, b.label, b.vec_id AS nb, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank
 FROM e a JOIN e b ON a.fold = 0 AND b.fold <> 0)"""


@query(
    "k9_knn_classifier",
    f"""WITH {_KF}, v AS (SELECT vec_id, label, count(*) AS c FROM n WHERE rank <= 5 GROUP BY 1, 2)
SELECT vec_id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS i FROM v) WHERE i = 1""",
)
def _(spark, d):
    train, test = _folds(spark, d)
    return knn.knn_predict(train, test, "vec_id", "embedding", "label", 5)


@query("k19_knn_regressor", f"WITH {_KF} SELECT vec_id, round(avg(label), 6) AS prediction FROM n WHERE rank <= 7 GROUP BY 1")
def _(spark, d):
    train, test = _folds(spark, d)
    return round_all(knn.knn_predict(train, test, "vec_id", "embedding", "label", 7, task="regression"))


# ---------------------------------------------------------------- cluster scores on the given labels

_LONG = "l AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings)"
_CENT = f"{_LONG}, c AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM l GROUP BY 1, 2), g AS (SELECT i, avg(x) AS m FROM l GROUP BY 1)"


@query(
    "n1_cluster_scores",
    f"""WITH {_CENT}, b AS (SELECT sum(c.n * pow(c.m - g.m, 2)) AS v FROM c JOIN g USING (i)), w AS (SELECT sum(pow(x - m, 2)) AS v FROM l JOIN c USING (label, i)),
 k AS (SELECT count(DISTINCT label) AS k, count(*) AS n, min(f) AS f FROM embeddings, (SELECT min(count(*) / (SELECT count(*) FROM embeddings)::DOUBLE) OVER () AS f FROM embeddings GROUP BY label LIMIT 1)),
 dist AS (SELECT label, avg(d) AS s FROM (SELECT label, vec_id, sqrt(sum(pow(x - m, 2))) AS d FROM l JOIN c USING (label, i) GROUP BY 1, 2) GROUP BY 1),
 gap AS (SELECT a.label AS p, b.label AS q, sqrt(sum(pow(a.m - b.m, 2))) AS d FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2),
 db AS (SELECT p, max((x.s + y.s) / d) AS v FROM gap JOIN dist x ON x.label = p JOIN dist y ON y.label = q GROUP BY 1)
SELECT round((b.v / (k - 1)) / (w.v / (n - k)), 6) AS calinski_harabasz, (SELECT round(avg(v), 6) FROM db) AS davies_bouldin, round(f, 6) AS min_freq FROM b, w, k""",
)
def _(spark, d):
    s = cluster.cluster_scores(emb(spark, d), "embedding", "label")
    return round_all(report(spark, [(s["Calinski-Harabasz"], s["Davies-Bouldin"], s["min_freq"])], "calinski_harabasz double, davies_bouldin double, min_freq double"))


def _sil_sql(dist):
    return f"""WITH p AS (SELECT a.vec_id, a.label, b.label AS g, sum({dist}) AS s FROM embeddings a JOIN embeddings b ON true GROUP BY 1, 2, 3),
n AS (SELECT label AS g, count(*) AS n FROM embeddings GROUP BY 1),
ab AS (SELECT vec_id, label, max(s / (n - 1)) FILTER (g = label) AS a, min(s / n) FILTER (g <> label) AS b FROM p JOIN n USING (g) GROUP BY 1, 2)
SELECT vec_id, label, round((b - a) / greatest(a, b), 6) + 0.0 AS s FROM ab"""


@query("n2_silhouette_squared", _sil_sql(f"pow({DIST}, 2)"))
def _(spark, d):
    return round_all(cluster.silhouette(emb(spark, d), "embedding", "label").select("vec_id", "label", "s"))


@query("n2_silhouette_pairwise", _sil_sql(DIST))
def _(spark, d):
    df = knn.silhouette_blocks(emb(spark, d), "vec_id", "embedding", "label")
    return round_all(df.withColumn("label", F.col("label").cast("int")))


@query(
    "n6_silhouette_table",
    f"""WITH t AS ({_sil_sql(f'pow({DIST}, 2)')}) SELECT label AS cluster, s, row_number() OVER (PARTITION BY label ORDER BY s) AS position, round(avg(s) OVER (), 4) AS mean_s FROM t""",
)
def _(spark, d):
    s = cluster.silhouette(emb(spark, d), "embedding", "label").select("label", r(F.col("s")).alias("s"))
    t = cluster.silhouette_table(s, "label")
    rows = t.withColumn("position", F.explode(F.sequence("position", F.col("position") + F.col("n") - 1)))
    return rows.select("cluster", "s", "position", F.round("mean_s", 4).alias("mean_s"))


@query("w6_ordered_in_group", "SELECT event_type AS cluster, value AS s, count(*) AS n, any_value(rk) AS position FROM (SELECT event_type, value, rank() OVER (PARTITION BY event_type ORDER BY value) AS rk FROM events) GROUP BY 1, 2")
def _(spark, d):
    return cluster.silhouette_table(table(spark, d, "events").withColumn("s", F.col("value")), "event_type").select("cluster", "s", "n", "position")


_AGREE = """ct AS (SELECT l_returnflag AS a, o_orderstatus AS b, count(*)::DOUBLE AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
na AS (SELECT a, sum(n) AS na FROM ct GROUP BY 1), nb AS (SELECT b, sum(n) AS nb FROM ct GROUP BY 1),
t AS (SELECT (SELECT sum(n) FROM ct) AS n, (SELECT sum(n*(n-1)/2) FROM ct) AS tk, (SELECT sum(na*(na-1)/2) FROM na) AS pa, (SELECT sum(nb*(nb-1)/2) FROM nb) AS pb,
 (SELECT -sum(na / t * ln(na / t)) FROM na, (SELECT sum(n) AS t FROM ct)) AS ha, (SELECT -sum(nb / t * ln(nb / t)) FROM nb, (SELECT sum(n) AS t FROM ct)) AS hb,
 (SELECT -sum(n / t * ln(n / nb)) FROM ct JOIN nb USING (b), (SELECT sum(n) AS t FROM ct)) AS hab, (SELECT -sum(n / t * ln(n / na)) FROM ct JOIN na USING (a), (SELECT sum(n) AS t FROM ct)) AS hba),
u AS (SELECT *, 1 - hab / ha AS h, 1 - hba / hb AS c FROM t)"""


def _pairs(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"])


@query(
    "n3_agreement",
    f"""WITH {_AGREE} SELECT round(tk / sqrt(pa * pb), 6) AS fowlkes_mallows, round((n*(n-1)/2 + 2*tk - pa - pb) / (n*(n-1)/2), 6) AS rand,
 round(h, 6) + 0.0 AS homogeneity, round(c, 6) + 0.0 AS completeness, round(2*h*c/(h+c), 6) + 0.0 AS v_measure FROM u""",
)
def _(spark, d):
    a = cluster.agreement(_pairs(spark, d), "l_returnflag", "o_orderstatus")
    names = {"Fowlkes-Mallows": "fowlkes_mallows", "RandScore": "rand", "Homogeneity": "homogeneity", "Completeness": "completeness", "V-Measure": "v_measure"}
    return round_all(a.select([col(k).alias(v) for k, v in names.items()]))


@query(
    "n4_agreement_cramers_v",
    """WITH e AS (SELECT label, (vec_id % 3)::VARCHAR AS g FROM embeddings), ct AS (SELECT label AS a, g AS b, count(*)::DOUBLE AS n FROM e GROUP BY 1, 2),
s AS (SELECT sum(n) AS n, count(DISTINCT a)::DOUBLE AS r, count(DISTINCT b)::DOUBLE AS k, greatest(0, sum(n) * (sum(n / na * (n / nb)) - 1)) AS chi2 FROM ct
 JOIN (SELECT a, sum(n) AS na FROM ct GROUP BY 1) USING (a) JOIN (SELECT b, sum(n) AS nb FROM ct GROUP BY 1) USING (b))
SELECT round(CASE WHEN least(r - (r-1)*(r-1)/(n-1), k - (k-1)*(k-1)/(n-1)) - 1 = 0 THEN 0 ELSE sqrt(greatest(0, chi2/n - (k-1)*(r-1)/(n-1)) / (least(r - (r-1)*(r-1)/(n-1), k - (k-1)*(k-1)/(n-1)) - 1)) END, 6) AS v FROM s""",
)
def _(spark, d):
    e = emb(spark, d).withColumn("g", (F.col("vec_id") % 3).cast("string"))
    return cluster.agreement(e, "label", "g").select(F.round("CramersV", 6).alias("v"))


@query(
    "n5_bic",
    f"""WITH {_CENT}, s AS (SELECT label, any_value(c.n)::DOUBLE AS n, sum(pow(x - m, 2)) AS sse FROM l JOIN c USING (label, i) GROUP BY 1), d AS (SELECT count(DISTINCT i) AS p FROM l), t AS (SELECT count(*) AS n FROM embeddings)
SELECT round(sum(s.n * ln(s.n) - s.n * ln(t.n) - s.n * p / 2.0 * ln(2 * pi() * sse / (s.n - 1)) - (s.n - 1) / 2) - ((count(*) - 1) + any_value(p) * count(*) + 1) / 2.0 * ln(any_value(t.n)), 3)::DOUBLE AS bic FROM s, d, t""",
)
def _(spark, d):
    return report(spark, [(round(cluster.bic(emb(spark, d), "embedding", "label"), 3),)], "bic double")


@query("a12_min_frequency", "SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM embeddings)::DOUBLE, 6) AS freq FROM embeddings GROUP BY 1")
def _(spark, d):
    return round_all(cluster.min_frequency(emb(spark, d), "label"))


@query("c14_cluster_profile_lines", f"WITH {_LONG} SELECT label::VARCHAR AS \"group\", 'x' || i AS variable, round(avg(x), 6) + 0.0 AS mean FROM l GROUP BY 1, 2")
def _(spark, d):
    e = emb(spark, d)
    n = e.select(F.size("embedding")).first()[0]
    wide = e.select("label", *[F.col("embedding")[i].alias(f"x{i}") for i in range(n)]).withColumn("label", F.col("label").cast("string"))
    return round_all(charts.group_means(wide, "label", [f"x{i}" for i in range(n)]).select("group", "variable", "mean"))


# ---------------------------------------------------------------- cluster models

_SIX = 6


def _shares(df):
    return df.groupBy("cluster_label").agg(F.count("*").alias("n"))


for _name in cluster.MODELS:
    if _name == "DBSCAN":
        continue
    _slug = {"KMeans": "l1", "GaussianMixture_full": "l2", "BIRCH": "l6"}.get(_name) or {"Ga": "l3", "Ba": "l4", "Ag": "l5", "Sp": "l8"}[_name[:2]]

    @query(f"{_slug}_{_name.lower()}")
    def _(spark, d, name=_name):
        if name == "BIRCH" or name.startswith("Agglomerative"):  # with the radius of the summary that was clustered
            how = cluster.birch if name == "BIRCH" else lambda df, k, x: cluster.agglomerative(df, k, name.split("_")[1], x)
            rows, reached = how(emb(spark, d), _SIX, "embedding")
            return _shares(rows).withColumn("threshold", F.lit(reached))
        return _shares(cluster.fit_predict(emb(spark, d), name, _SIX, "vec_id", "embedding"))


@query("l7_dbscan")
def _(spark, d):
    return cluster.dbscan(emb(spark, d), "vec_id", "embedding", eps=EPS, min_samples=5, pivots=4).select("vec_id", "cluster_label")


@query("l9_sweep")
def _(spark, d):
    return cluster.sweep(emb(spark, d), ["KMeans"], 2, 4, "vec_id", "embedding", bootstraps=2)


@query("l10_prediction_strength")
def _(spark, d):
    return cluster.prediction_strength(emb(spark, d), ["KMeans"], 2, 3, "vec_id", folds=2, repeats=1, features="embedding")


@query("l12_labels_and_preparation")
def _(spark, d):
    c = table(spark, d, "customer").drop("c_name")
    return cluster.labels_and_preparation(c, "KMeans", 4, "c_custkey").select("c_custkey", reshape.cluster_text(F.col("cluster_label")).alias("cluster_label"))


@query("s8_write_back")
def _(spark, d):
    from lakelens.operators.profile import describe_categorical

    c = table(spark, d, "customer").drop("c_name")
    labels = cluster.labels_and_preparation(c, "KMeans", 4, "c_custkey").select("c_custkey", reshape.cluster_text(F.col("cluster_label")).alias("cluster_label"))
    return describe_categorical(c.join(labels, "c_custkey"))


# ---------------------------------------------------------------- anomaly detectors

EV = ["l_quantity", "l_extendedprice", "l_discount"]


def _lines(spark, d):
    from lakelens.registry.base import LINE_ID

    li = table(spark, d, "lineitem")
    key = F.concat_ws("|", *LINE_ID)
    return li.select(key.alias("row_id"), F.array(*EV).alias("features"), *EV)


def _customers(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.array(F.col("c_acctbal"), F.col("c_nationkey").cast("double")).alias("features"))


_HB = ["c_acctbal", "c_nationkey"]


def _hbos_sql():
    ends = ", ".join(f"min({c})::DOUBLE AS lo_{c}, max({c})::DOUBLE AS hi_{c}" for c in _HB)
    parts = []
    for c in _HB:
        edge = lambda j: f"(lo_{c} + (hi_{c} - lo_{c}) / 10 * {j})" if j < 10 else f"hi_{c}"
        cnt = [
            f"(SELECT count(*) FROM customer, e WHERE {c} >= {edge(j)} AND {c} {'<=' if j == 9 else '<'} {edge(j + 1)})" for j in range(10)
        ]
        parts.append((c, cnt, " + ".join(f"({c} > {edge(j)})::INTEGER" for j in range(1, 10))))
    h = ", ".join(f"[{', '.join(cnt)}] AS h_{c}" for c, cnt, _ in parts)
    score = " + ".join(f"-log2(h_{c}[1 + {at}] / (SELECT count(*) FROM customer)::DOUBLE / ((hi_{c} - lo_{c}) / 10) + 0.1::DOUBLE)" for c, _, at in parts)
    return f"WITH e AS (SELECT {ends} FROM customer), h AS (SELECT {h}), s AS (SELECT c_custkey, {score} AS v FROM customer, e, h)" + _SCALED.format(key="c_custkey")


_SCALED = " SELECT {key}, round((v - (SELECT min(v) FROM s)) / (SELECT max(v) - min(v) FROM s), 6) AS anomaly_score FROM s"


@query("o1_hbos", _hbos_sql())
def _(spark, d):
    return round_all(anomaly.anomaly_scores(_customers(spark, d), "HBOS", "c_custkey").select("c_custkey", "anomaly_score"))


def _tail_sql(kind):
    tails = ", ".join(
        f"-ln(cume_dist() OVER (ORDER BY {c})) AS l_{c}, -ln(cume_dist() OVER (ORDER BY {c} DESC)) AS r_{c}, sign((SELECT avg(pow({c} - m, 3)) FROM customer, (SELECT avg({c}) AS m FROM customer))) AS k_{c}"
        for c in _HB
    )

    def one(c):
        skewed = f"(CASE k_{c} WHEN -1 THEN l_{c} WHEN 1 THEN r_{c} ELSE l_{c} + r_{c} END)"
        return f"greatest({skewed}, (l_{c} + r_{c}) / 2)" if kind == "copod" else f"greatest({skewed}, l_{c}, r_{c})"

    return f"WITH t AS (SELECT c_custkey, {tails} FROM customer), s AS (SELECT c_custkey, {' + '.join(one(c) for c in _HB)} AS v FROM t)" + _SCALED.format(key="c_custkey")


for _kind, _slug in (("ecod", "o2_ecod"), ("copod", "o3_copod")):

    @query(_slug, _tail_sql(_kind))
    def _(spark, d, kind=_kind):
        return round_all(anomaly.anomaly_scores(_customers(spark, d), kind.upper(), "c_custkey").select("c_custkey", "anomaly_score"))


@query("o4_pca")
def _(spark, d):
    return anomaly.anomaly_scores(_lines(spark, d), "PCA", "row_id").select("row_id", "anomaly_score")


@query("o5_knn", f"WITH {NEAR}, s AS (SELECT vec_id, max(distance) AS v FROM nn WHERE rank <= 5 GROUP BY 1)" + _SCALED.format(key="vec_id"))
def _(spark, d):
    return round_all(anomaly.anomaly_scores(emb(spark, d), "KNN", "vec_id", "embedding").select("vec_id", "anomaly_score"))


@query(
    "o6_lof",
    f"""WITH {NEAR}, n20 AS (SELECT * FROM nn WHERE rank <= 20), kd AS (SELECT vec_id, max(distance) AS kd FROM n20 GROUP BY 1),
lrd AS (SELECT n20.vec_id, 1 / (avg(greatest(distance, kd.kd)) + 1e-10) AS lrd FROM n20 JOIN kd ON kd.vec_id = neighbour GROUP BY 1),
s AS (SELECT n20.vec_id, avg(b.lrd) / any_value(a.lrd) AS v FROM n20 JOIN lrd a ON a.vec_id = n20.vec_id JOIN lrd b ON b.vec_id = neighbour GROUP BY 1)"""
    + _SCALED.format(key="vec_id"),
)
def _(spark, d):
    return round_all(anomaly.anomaly_scores(emb(spark, d), "LOF", "vec_id", "embedding").select("vec_id", "anomaly_score"))


_CB = f"""{_CENT}, sz AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), pd AS (SELECT vec_id, c.label, sqrt(sum(pow(x - m, 2))) AS d FROM l JOIN c ON c.i = l.i GROUP BY 1, 2),
own AS (SELECT vec_id, arg_min(label, d) AS label, min(d) AS d FROM pd GROUP BY 1), cs AS (SELECT label, count(*) AS n FROM own GROUP BY 1),
o AS (SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS i, sum(n) OVER (ORDER BY n DESC, label) AS cum, lead(n) OVER (ORDER BY n DESC, label) AS nx, (SELECT count(*) FROM embeddings) AS t, count(*) OVER () AS k FROM cs),
cutoff AS (SELECT coalesce(min(i) FILTER (i < k AND cum >= 0.9 * t AND n / nx::DOUBLE >= 5), min(i) FILTER (i < k AND cum >= 0.9 * t), min(i) FILTER (i < k AND n / nx::DOUBLE >= 5), any_value(k)) AS c FROM o),
big AS (SELECT label FROM o, cutoff WHERE i <= c),
s AS (SELECT own.vec_id, CASE WHEN own.label IN (SELECT label FROM big) THEN own.d ELSE (SELECT min(d) FROM pd WHERE pd.vec_id = own.vec_id AND pd.label IN (SELECT label FROM big)) END AS v FROM own)"""


@query("o7_cblof_given_centres", f"WITH {_CB}" + _SCALED.format(key="vec_id"))
def _(spark, d):
    import numpy as np

    e = emb(spark, d)
    per = sorted(cluster._centroids(e, "embedding", "label").items(), key=lambda kv: int(kv[0]))
    scored = anomaly.cblof(e, "embedding", centres=np.array([v[1] for _, v in per]))
    return round_all(anomaly.scale_score(scored).select("vec_id", "anomaly_score"))


@query("o7_cblof")
def _(spark, d):
    return anomaly.anomaly_scores(_lines(spark, d), "CBLOF", "row_id").select("row_id", "anomaly_score")


for _name, _slug in (("Iforest", "o8_isolation_forest"), ("LODA", "o9_loda"), ("MCD", "o10_mcd")):

    @query(_slug)
    def _(spark, d, name=_name):
        return anomaly.anomaly_scores(_lines(spark, d), name, "row_id").select("row_id", "anomaly_score")


@query("o11_score_table")
def _(spark, d):
    o = table(spark, d, "orders")
    return anomaly.scores_and_preparation(o.select("o_orderkey", "o_totalprice", "o_orderstatus"), "ECOD", "o_orderkey").select("o_orderkey", "anomaly_score")


@query("o12_detector_cv")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return anomaly.cross_validate_detectors(c, ["HBOS"], "c_custkey", folds=2, repeats=1).drop("time")


_SEL = "s0 AS (SELECT event_id, value, user_id::DOUBLE AS user_id, value / (SELECT max(value) FROM events) AS anomaly_score FROM events)"
_VARS = ["value", "user_id", "anomaly_score"]


def _scored_events(spark, d):
    e = table(spark, d, "events")
    top = e.agg(F.max("value")).first()[0]
    return e.select("event_id", "value", "user_id", (F.col("value") / F.lit(top)).alias("anomaly_score"))


@query(
    "c13_profile_lines",
    f"WITH {_SEL} "
    + _union(
        [f"SELECT event_id::VARCHAR AS index, '{c}' AS variable, round({c}, 6) AS value FROM s0 WHERE anomaly_score >= 0.5" for c in _VARS]
        + [f"SELECT '{k}_all', '{c}', round({f}({c}), 6) FROM s0" for c in _VARS for k, f in (("median", "median"), ("mean", "avg"))]
    ),
)
def _(spark, d):
    return round_all(anomaly.selected_cases(_scored_events(spark, d), "event_id", ["value", "user_id"], 0.5))


@query("a11_reference_rows", f"WITH {_SEL} " + _union(f"SELECT '{k}_all' AS index, round({f}(value), 6) AS value, round({f}(user_id), 6) AS user_id FROM s0" for k, f in (("median", "median"), ("mean", "avg"))))
def _(spark, d):
    return round_all(anomaly.reference_rows(_scored_events(spark, d), ["value", "user_id"]))


@query("o14_above_cutoff", f"WITH {_SEL} SELECT count(*) AS n FROM s0 WHERE anomaly_score >= 0.5")
def _(spark, d):
    return _scored_events(spark, d).where("anomaly_score >= 0.5").agg(F.count("*").alias("n"))


@query(
    "s5_export_scored",
    f"WITH {_SEL} SELECT event_id, round(anomaly_score, 6) AS anomaly_score, anomaly_score >= 0.5 AS anomaly_label FROM s0",
)
def _(spark, d):
    import uuid

    from lakelens.plans.session import checkpoint_root
    from lakelens.sources.io import write_table

    scored = _scored_events(spark, d).withColumn("anomaly_label", reshape.threshold_label(F.col("anomaly_score"), 0.5))
    path = f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"
    write_table(scored, path, "parquet")
    return round_all(spark.read.parquet(path).select("event_id", "anomaly_score", "anomaly_label"))
