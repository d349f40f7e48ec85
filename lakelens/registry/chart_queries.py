"""Ranks, chart tables, preparation, splits, scores and evaluation tables."""

from __future__ import annotations

from itertools import accumulate
from math import exp, factorial

from pyspark.sql import functions as F

from lakelens.functions.columns import col, number, r
from lakelens.functions.dist import norm_cdf_udf, norm_ppf_udf
from lakelens.operators import charts, evaluate, metrics, prep, split
from lakelens.operators.reshape import stack_results
from lakelens.plans.ranking import average_rank_table, ecdf, running_totals, shuffled_row_number
from lakelens.registry.base import GAPS, JOINED, LINE_ID, PRED, joined, predictions, query, with_gaps
from lakelens.sources.io import table

NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(parts):
    return " UNION ALL ".join(parts)


def _round(df, digits=6, *names):
    kinds = dict(df.dtypes)
    return df.withColumns({c: r(col(c), digits) for c in (names or df.columns) if kinds[c] == "double"})


# ---------------------------------------------------------------- ranks and order


@query(
    "w1_running_total",
    "SELECT o_totalprice AS value, n, sum(n) OVER (ORDER BY o_totalprice)::BIGINT AS n_cum FROM (SELECT o_totalprice, count(*) AS n FROM orders GROUP BY 1)",
)
def _(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_totalprice").alias("value")).agg(F.count("*").alias("n"))
    return running_totals(counts, "value", ["n"])


@query("w2_ecdf", "SELECT value, count(*) AS n, round(any_value(e), 6) AS ecdf FROM (SELECT value, cume_dist() OVER (ORDER BY value) AS e FROM events) GROUP BY value")
def _(spark, d):
    return _round(ecdf(table(spark, d, "events"), "value"), 6, "ecdf")


_MONTHS = "SELECT (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS trial, round(avg(o_totalprice), 2) AS value FROM orders GROUP BY 1"


def _months(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("trial")).agg(F.round(F.avg("o_totalprice"), 2).alias("value"))


@query("w3_running_best", f"SELECT trial, value, max(value) OVER (ORDER BY trial) AS best FROM ({_MONTHS})")
def _(spark, d):
    return metrics.trial_history(_months(spark, d))


@query(
    "w4_average_rank",
    _union(
        f"SELECT '{c}' AS variable, {c}::DOUBLE AS value, count(*) AS n, any_value(rk) AS rank FROM (SELECT {c}, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS rk FROM lineitem) GROUP BY {c}"
        for c in NUMS
    ),
)
def _(spark, d):
    return average_rank_table(table(spark, d, "lineitem"), NUMS)


@query(
    "w5_plotting_positions",
    """SELECT value, n, (sum(n) OVER (ORDER BY value) - n + 1)::BIGINT AS "first", (sum(n) OVER (ORDER BY value))::BIGINT AS "last" FROM (SELECT value, count(*) AS n FROM events GROUP BY value)""",
)
def _(spark, d):
    return charts.qq_points(table(spark, d, "events"), "value").select("value", "n", "first", "last")


@query("c4_qq_points")
def _(spark, d):
    return charts.qq_points(table(spark, d, "lineitem"), "l_extendedprice")


@query("x2_normal", """SELECT c_custkey FROM customer""")
def _(spark, d):
    c = table(spark, d, "customer")
    mean, sd = c.agg(F.avg("c_acctbal"), F.stddev_pop("c_acctbal")).first()
    z = (F.col("c_acctbal") - F.lit(mean)) / F.lit(sd)
    back = c.withColumn("z", z).withColumn("back", norm_ppf_udf(norm_cdf_udf("z")))
    return back.where(F.abs(F.col("back") - F.col("z")) < 1e-9).select("c_custkey")


@query("w8_sort", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1 ORDER BY 2 DESC")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean_price")).orderBy(F.desc("mean_price"))


@query("w9_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query(
    "w10_sample_curves",
    "SELECT o_orderkey FROM orders WHERE ('0x' || substr(md5(concat_ws('|', o_orderkey, '5')), 1, 13))::BIGINT / pow(2.0, 52) < 0.1",
)
def _(spark, d):
    return table(spark, d, "orders").where(split.unit_hash(["o_orderkey"], 5) < 0.1).select("o_orderkey")


# ---------------------------------------------------------------- charts


@query("c1_category_counts", "SELECT event_type AS category, count(*)::DOUBLE AS value, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM events GROUP BY 1")
def _(spark, d):
    return _round(charts.category_chart(table(spark, d, "events"), "event_type"))


@query(
    "c1_category_means",
    "SELECT event_type AS category, round(avg(value), 6) AS value, round(avg(value) / sum(avg(value)) OVER (), 6) AS share FROM events GROUP BY 1",
)
def _(spark, d):
    return _round(charts.category_chart(table(spark, d, "events"), "event_type", "value"))


_FD = "fd AS (SELECT 2 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / pow(count(*), 1.0::DOUBLE/3) AS w, min(value) AS lo FROM events)"


def _hist_sql(group):
    return f"""WITH {_FD}, h AS (SELECT {group} AS "group", floor((value - lo) / w)::BIGINT AS bin, count(*) AS n FROM events, fd GROUP BY 1, 2)
SELECT "group", bin, round(lo + bin * w, 6) AS "left", round(lo + (bin + 1) * w, 6) AS "right", n, round(n / (sum(n) OVER (PARTITION BY "group") * w), 6) AS density FROM h, fd"""


@query("c2_histogram", _hist_sql("'Density'"))
def _(spark, d):
    return _round(charts.histogram(table(spark, d, "events"), "value"))


@query("c2_histogram_by_group", _hist_sql("event_type"))
def _(spark, d):
    return _round(charts.histogram(table(spark, d, "events"), "value", "event_type"))


@query(
    "c3_density",
    """WITH st AS (SELECT event_type, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2::DOUBLE) AS h, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
v AS (SELECT event_type, avg(value) AS value, count(*) AS k FROM events JOIN st USING (event_type) GROUP BY 1, floor((value - lo) / (h / 50))), g AS (SELECT range AS i FROM range(500))
SELECT event_type AS "group", i::INTEGER AS i, round(any_value(lo + i * (hi - lo) / 500), 6) AS x,
 round(sum(k * exp(-0.5 * pow((lo + i * (hi - lo) / 500 - value) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 6) AS density
FROM v JOIN st USING (event_type), g GROUP BY 1, 2""",
)
def _(spark, d):
    return _round(charts.density_curve(table(spark, d, "events"), "value", "event_type"))


@query(
    "c5_box_summary",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS md, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type AS "group", round(q1, 6) AS q1, round(md, 6) AS median, round(q3, 6) AS q3, count(*) AS n, min(value) AS min, max(value) AS max,
 min(value) FILTER (value BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1)) AS low_whisker, max(value) FILTER (value BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1)) AS high_whisker,
 count(*) FILTER (NOT (value BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1))) AS n_outside FROM events JOIN q USING (event_type) GROUP BY 1, q1, md, q3""",
)
def _(spark, d):
    return _round(charts.box_summary(table(spark, d, "events"), "value", "event_type"))


@query(
    "c6_two_way_counts",
    f"""WITH {JOINED} SELECT o_orderpriority AS target, l_returnflag AS feature, count(*) AS n,
 round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS pct FROM j GROUP BY 1, 2""",
)
def _(spark, d):
    return _round(charts.two_way_counts(joined(spark, d), "o_orderpriority", "l_returnflag"))


@query(
    "c7_linear_trend",
    """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
 round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem""",
)
def _(spark, d):
    df = charts.linear_trend(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return df.select(F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@query("c8_lowess")
def _(spark, d):
    return charts.lowess_trend(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query(
    "c9_marginals",
    """WITH q AS (SELECT quantile_cont(l_quantity, 0.25) AS a1, median(l_quantity) AS a2, quantile_cont(l_quantity, 0.75) AS a3, quantile_cont(l_extendedprice, 0.25) AS b1,
 median(l_extendedprice) AS b2, quantile_cont(l_extendedprice, 0.75) AS b3 FROM lineitem)
SELECT 'x' AS axis, round(a1, 6) AS q1, round(a2, 6) AS median, round(a3, 6) AS q3 FROM q UNION ALL SELECT 'y', round(b1, 6), round(b2, 6), round(b3, 6) FROM q""",
)
def _(spark, d):
    li = table(spark, d, "lineitem")
    box = lambda c, a: charts.box_summary(li, c).select(F.lit(a).alias("axis"), "q1", "median", "q3")
    return _round(box("l_quantity", "x").unionByName(box("l_extendedprice", "y")))


@query(
    "c10_group_means",
    f"""WITH {JOINED}, g AS ({_union(f"SELECT c_mktsegment AS g, '{c}' AS variable, avg({c}) AS mean FROM j GROUP BY 1" for c in ("l_quantity", "l_discount", "o_totalprice"))})
SELECT g AS "group", variable, round(mean, 4) AS mean, round(100 * mean / sum(mean) OVER (PARTITION BY variable), 6) AS pct FROM g""",
)
def _(spark, d):
    df = charts.group_means(joined(spark, d), "c_mktsegment", ["l_quantity", "l_discount", "o_totalprice"])
    return df.withColumns({"mean": F.round("mean", 4), "pct": F.round("pct", 6)})


@query(
    "c11_bubble_table",
    f"""WITH {GAPS} SELECT l_quantity AS x, l_extendedprice AS y, l_tax AS size, l_returnflag AS color, l_linestatus AS label FROM m
 WHERE l_tax IS NOT NULL AND l_returnflag IS NOT NULL""",
)
def _(spark, d):
    return charts.bubble_table(with_gaps(spark, d), "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus")


@query(
    "c12_score_distribution",
    """WITH sc AS (SELECT value / (SELECT max(value) FROM events) AS s FROM events),
fd AS (SELECT 2 * (quantile_cont(s, 0.75) - quantile_cont(s, 0.25)) / pow(count(*), 1.0::DOUBLE/3) AS w, min(s) AS lo, count(*) AS t FROM sc)
SELECT floor((s - lo) / w)::BIGINT AS bin, count(*) AS n, round(100.0::DOUBLE * count(*) / any_value(t), 6) AS pct FROM sc, fd GROUP BY 1""",
)
def _(spark, d):
    e = table(spark, d, "events")
    top = e.agg(F.max("value")).first()[0]
    scored = e.select((F.col("value") / F.lit(top)).alias("anomaly_score"))
    return _round(charts.score_distribution(scored)["histogram"].select("bin", "n", "pct"))


@query(
    "c15_metric_lines",
    """WITH p AS (SELECT o_orderstatus AS model, (year(o_orderdate) % 10)::INTEGER AS n_clusters, avg(o_totalprice) AS ch, avg(o_custkey) AS sil FROM orders GROUP BY 1, 2)
SELECT model, n_clusters, 'Calinski-Harabasz' AS metric, round((ch - min(ch) OVER (PARTITION BY model)) / (max(ch) OVER (PARTITION BY model) - min(ch) OVER (PARTITION BY model)), 6) AS scaled_score FROM p
UNION ALL SELECT model, n_clusters, 'Silhouette', round(sil, 6) FROM p""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    s = o.select(
        F.col("o_orderstatus").alias("model"), (F.year("o_orderdate") % 10).alias("n_clusters"), F.col("o_totalprice").alias("Calinski-Harabasz"), F.col("o_custkey").alias("Silhouette")
    )
    return _round(charts.metric_lines(s, ["Calinski-Harabasz", "Silhouette"]))


@query(
    "c18_missingness_counts",
    f"""WITH {GAPS} SELECT CASE WHEN l_tax IS NULL THEN 'missing' ELSE 'present' END AS target, l_linestatus AS feature, count(*) AS n,
 round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY l_tax IS NULL), 6) AS pct FROM m GROUP BY l_tax IS NULL, 1, 2""",
)
def _(spark, d):
    return _round(charts.missingness_counts(with_gaps(spark, d), "l_tax", "l_linestatus"))


@query(
    "c18_missingness_means",
    f"""WITH {GAPS}, g AS (SELECT CASE WHEN l_tax IS NULL THEN 'missing' ELSE 'present' END AS g, avg(l_quantity) AS mean FROM m GROUP BY 1)
SELECT g AS "group", 'l_quantity' AS variable, round(mean, 6) AS mean, round(100 * mean / sum(mean) OVER (), 6) AS pct FROM g""",
)
def _(spark, d):
    return _round(charts.missingness_means(with_gaps(spark, d), "l_tax", ["l_quantity", "l_tax"]))


# ---------------------------------------------------------------- preparation

_BY_LINE = "SELECT l_linenumber, round(sum(v), 4) + 0.0 AS total, round(min(v), 6) + 0.0 AS lo, round(max(v), 6) + 0.0 AS hi FROM x GROUP BY 1"


def _by_line(df, c):
    return df.groupBy("l_linenumber").agg(r(F.sum(c), 4).alias("total"), r(F.min(c)).alias("lo"), r(F.max(c)).alias("hi"))


def _prep_sql(value):
    return f"WITH {GAPS}, x AS (SELECT l_linenumber, {value} AS v FROM m) {_BY_LINE}"


for _kind, _value in (
    ("mean", "coalesce(l_tax, (SELECT avg(l_tax) FROM m))"),
    ("median", "coalesce(l_tax, (SELECT median(l_tax) FROM m))"),
    ("most_frequent", "coalesce(l_tax, (SELECT l_tax FROM m WHERE l_tax IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))"),
):

    @query(f"f2_impute_{_kind}", _prep_sql(_value))
    def _(spark, d, kind=_kind):
        df = with_gaps(spark, d)
        return _by_line(prep.NumericImputer(inputCols=["l_tax"], method=kind).fit(df).transform(df), "l_tax")


@query(
    "f3_impute_category",
    f"""WITH {GAPS} SELECT coalesce(l_returnflag, (SELECT l_returnflag FROM m WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag, count(*) AS n FROM m GROUP BY 1""",
)
def _(spark, d):
    df = with_gaps(spark, d)
    return prep.CategoryImputer(inputCols=["l_returnflag"]).fit(df).transform(df).groupBy("l_returnflag").agg(F.count("*").alias("n"))


for _kind, _value in (
    ("maxabs", "l_extendedprice / (SELECT max(abs(l_extendedprice)) FROM m)"),
    ("minmax", "(l_extendedprice - (SELECT min(l_extendedprice) FROM m)) / (SELECT max(l_extendedprice) - min(l_extendedprice) FROM m)"),
    ("robust", "(l_extendedprice - (SELECT median(l_extendedprice) FROM m)) / (SELECT quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) FROM m)"),
    ("zscore", "(l_extendedprice - (SELECT avg(l_extendedprice) FROM m)) / (SELECT stddev_pop(l_extendedprice) FROM m)"),
):

    @query({"maxabs": "f7_maxabs", "minmax": "f8_minmax", "robust": "f9_robust", "zscore": "f11_zscore"}[_kind], _prep_sql(_value))
    def _(spark, d, kind=_kind):
        df = with_gaps(spark, d)
        return _by_line(prep.Scaler(inputCols=["l_extendedprice"], method=kind).fit(df).transform(df), "l_extendedprice")


@query("f10_yeo_johnson_given_lambda", "WITH x AS (SELECT (c_nationkey % 7)::INTEGER AS l_linenumber, CASE WHEN c_acctbal >= 0 THEN (pow(c_acctbal + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - c_acctbal, 1.5) - 1) / 1.5 END AS v FROM customer) " + _BY_LINE)
def _(spark, d):
    c = table(spark, d, "customer")
    df = c.select((F.col("c_nationkey") % 7).alias("l_linenumber"), prep.yeo_johnson(number(c, "c_acctbal"), 0.5).alias("v"))
    return _by_line(df, "v")


@query("f10_yeo_johnson")
def _(spark, d):
    e = table(spark, d, "events")
    df = prep.Scaler(inputCols=["value"], method="yeo_johnson").fit(e).transform(e)
    return df.groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n"))


@query(
    "f12_one_hot",
    """WITH n AS (SELECT p_brand, count(*) AS k, (SELECT count(*) FROM part) AS t FROM part GROUP BY 1)
SELECT p_partkey, 'p_brand_' || CASE WHEN k >= 0.05::DOUBLE * t THEN p_brand ELSE 'infrequent_sklearn' END AS slot FROM part JOIN n USING (p_brand)
UNION ALL SELECT p_partkey, 'p_type_' || p_type FROM part""",
)
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    m = prep.OneHot(inputCols=["p_brand", "p_type"]).fit(p)
    return m.transform(p).unpivot(["p_partkey"], [col(c) for c in m.output_names()], "slot", "hit").where("hit = 1").select("p_partkey", "slot")


@query("f12_one_hot_binary", "SELECT l_linenumber, sum(CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END) AS \"l_linestatus_O\" FROM lineitem GROUP BY 1")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_linenumber", "l_linestatus")
    df = prep.OneHot(inputCols=["l_linestatus"]).fit(li).transform(li)
    return df.drop("l_linestatus").groupBy("l_linenumber").agg(*[F.sum(c).alias(c) for c in df.columns if c.startswith("l_linestatus_")])


@query("f14_label_codes", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS o_orderpriority_code, o_orderpriority AS decoded FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    m = prep.Levels(inputCols=["o_orderpriority"]).fit(o)
    return m.decode(m.transform(o), "o_orderpriority", "o_orderpriority_code", "decoded").select("o_orderkey", "o_orderpriority_code", "decoded")


@query("f1_preparation_pipeline")
def _(spark, d):
    from pyspark.ml.stat import Summarizer

    df = with_gaps(spark, d).select(*NUMS, "l_returnflag", "l_linestatus")
    out = prep.data_preprocessing(df).fit(df).transform(df)
    s = out.agg(Summarizer.mean(F.col("features")).alias("m"), Summarizer.count(F.col("features")).alias("n"))
    from pyspark.ml.functions import vector_to_array

    names = F.array(*[F.lit(c) for c in prep.feature_names(out)])
    return s.select(F.posexplode(vector_to_array("m")).alias("i", "mean"), "n", names.alias("names")).select(F.get("names", F.col("i")).alias("feature"), "mean", "n")


# ---------------------------------------------------------------- splits


def _order(ids, seed):
    return f"md5(concat_ws('|', {ids}, '{seed}')), {ids}"


@query(
    "v1_train_test_split",
    f"""SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_order('o_orderkey', 123)}) / (count(*) OVER (PARTITION BY o_orderpriority))::DOUBLE <= 0.8::DOUBLE AS is_train FROM orders""",
)
def _(spark, d):
    return split.train_test_split(table(spark, d, "orders"), "o_orderpriority", ["o_orderkey"]).select("o_orderkey", "is_train")


_BIN10 = """q AS (SELECT quantile_cont(o_totalprice, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e FROM orders),
st AS (SELECT *, len(list_filter((SELECT e FROM q), lambda v: v < o_totalprice)) AS stratum FROM orders)"""


@query(
    "v1_train_test_split_regression",
    f"""WITH {_BIN10} SELECT o_orderkey, row_number() OVER (PARTITION BY stratum ORDER BY {_order('o_orderkey', 123)}) / (count(*) OVER (PARTITION BY stratum))::DOUBLE <= 0.7::DOUBLE AS is_train FROM st""",
)
def _(spark, d):
    return split.train_test_split(table(spark, d, "orders"), "o_totalprice", ["o_orderkey"], 0.7).select("o_orderkey", "is_train")


@query(
    "v2_stratified_folds",
    "SELECT o_orderkey, " + ", ".join(f"((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_order('o_orderkey', 122 + i)}) - 1) % 5)::INTEGER AS fold_{i}" for i in (1, 2)) + " FROM orders",
)
def _(spark, d):
    return split.repeated_folds(table(spark, d, "orders"), ["o_orderkey"], 5, 2, target="o_orderstatus").select("o_orderkey", "fold_1", "fold_2")


@query(
    "v3_plain_folds",
    f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, ((row_number() OVER (ORDER BY {_order(', '.join(LINE_ID), 123)}) - 1) % 10)::INTEGER AS fold FROM lineitem",
)
def _(spark, d):
    return split.k_folds(table(spark, d, "lineitem"), LINE_ID, 10).select(*LINE_ID[:4], "fold")


@query(
    "w7_fold_number",
    f"""SELECT event_type, fold, count(*) AS n, min(event_id) AS first_id FROM (SELECT event_type, event_id,
 ((row_number() OVER (PARTITION BY event_type ORDER BY {_order('event_id', 9)}) - 1) % 7)::INTEGER AS fold FROM events) GROUP BY 1, 2""",
)
def _(spark, d):
    df = split.k_folds(table(spark, d, "events"), ["event_id"], 7, seed=9, target="event_type")
    return df.groupBy("event_type", "fold").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


_U = "('0x' || substr(md5(concat_ws('|', o_orderkey, '4')), 1, 13))::BIGINT / pow(2.0, 52)"
_POIS = " + ".join(f"({_U} >= {s!r}::DOUBLE)::INTEGER" for s in accumulate(exp(-1.0) / factorial(k) for k in range(12)))


@query("v4_bootstrap_weights", f"SELECT o_orderkey, {_POIS} AS weight FROM orders")
def _(spark, d):
    return split.bootstrap_weights(table(spark, d, "orders"), ["o_orderkey"], 4).select("o_orderkey", "weight")


@query(
    "v5_rebuild_fold",
    f"SELECT o_orderstatus, count(*) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_order('o_orderkey', 123)}) - 1) % 5 AS f FROM orders) WHERE f = 2 GROUP BY 1",
)
def _(spark, d):
    df = split.k_folds(table(spark, d, "orders"), ["o_orderkey"], 5, target="o_orderstatus")
    return split.fold_parts(df, "fold", 2)[1].groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(
    "v6_learning_subsets",
    _union(
        f"SELECT {f} ::DOUBLE AS fraction, count(*) AS n, sum(o_orderkey)::BIGINT AS key_sum FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_order('o_orderkey', 123)}) / (count(*) OVER ())::DOUBLE AS s FROM orders) WHERE s <= {f}::DOUBLE"
        for f in (0.1, 0.325, 0.55, 0.775, 1.0)
    ),
)
def _(spark, d):
    fr = [0.1, 0.325, 0.55, 0.775, 1.0]
    subs = split.learning_subsets(table(spark, d, "orders"), ["o_orderkey"], fr)
    parts = [s.agg(F.lit(f).alias("fraction"), F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum")) for f, s in zip(fr, subs)]
    return stack_results(parts)


# ---------------------------------------------------------------- scores


_REG = """round(avg(abs({y} - {p})), 4) AS "MAE", round(sqrt(avg(pow({y} - {p}, 2))), 4) AS "RMSE", round(sqrt(avg(pow(ln(1 + {y}) - ln(1 + {p}), 2))), 6) AS "RMSLE",
 round(1 - avg(pow({y} - {p}, 2)) / var_pop({y}), 6) AS "R2", round(avg(abs({y} - {p}) / {y}), 6) AS "MAPE" """.format(y="l_extendedprice", p="yhat")


def _reg(df):
    return df.select(*[c for c in df.columns if c == "l_linestatus"], *[F.round(c, 4).alias(c) for c in ("MAE", "RMSE")], *[F.round(c, 6).alias(c) for c in ("RMSLE", "R2", "MAPE")])


@query("r1_regression_scores", f"WITH {PRED} SELECT {_REG} FROM pred")
def _(spark, d):
    return _reg(metrics.regression_scores(predictions(spark, d), "l_extendedprice", "yhat"))


@query("r2_regression_scores_by_group", f"WITH {PRED} SELECT l_linestatus, {_REG} FROM pred GROUP BY 1")
def _(spark, d):
    return _reg(metrics.regression_scores(predictions(spark, d), "l_extendedprice", "yhat", by=["l_linestatus"]))


@query("r3_mape_signed", "SELECT c_mktsegment, round(avg(abs(c_acctbal - 100) / c_acctbal) FILTER (c_acctbal <> 0), 6) AS \"MAPE\" FROM customer GROUP BY 1")
def _(spark, d):
    c = table(spark, d, "customer").withColumn("hundred", F.lit(100.0))
    return metrics.regression_scores(c, "c_acctbal", "hundred", by=["c_mktsegment"]).select("c_mktsegment", F.round("MAPE", 6).alias("MAPE"))


_CLS = """cells AS (SELECT y, p, count(*)::DOUBLE AS n FROM pred GROUP BY 1, 2),
cl AS (SELECT c, coalesce((SELECT sum(n) FROM cells WHERE y = c AND p = c), 0) AS tp, (SELECT sum(n) FROM cells WHERE y = c) AS t, (SELECT sum(n) FROM cells WHERE p = c) AS q,
 (SELECT sum(n) FROM cells) AS s FROM (SELECT DISTINCT y AS c FROM pred UNION SELECT DISTINCT p FROM pred)),
tot AS (SELECT sum(tp) AS c, any_value(s) AS s, sum(t * q) AS tq, sum(t * t) AS tt, sum(q * q) AS qq FROM cl)"""
_AVG = {
    "macro": ("avg(tp / t)", "avg(tp / q)", "avg(2 * tp / (t + q))"),
    "weighted": ("sum(tp / t * t) / sum(t)", "sum(tp / q * t) / sum(t)", "sum(2 * tp / (t + q) * t) / sum(t)"),
    "micro": ("sum(tp) / sum(t)", "sum(tp) / sum(t)", "sum(tp) / sum(t)"),
}


def _cls_sql(avg):
    re, pr, f1 = _AVG[avg]
    return f"""WITH {PRED}, {_CLS} SELECT round(c / s, 6) AS "Accuracy", (SELECT round(avg((tp / t + 1 - (q - tp) / (s - t)) / 2), 6) FROM cl) AS "AUC",
 (SELECT round({re}, 6) FROM cl) AS "Recall", (SELECT round({pr}, 6) FROM cl) AS "Precision", (SELECT round({f1}, 6) FROM cl) AS "F1",
 round((c / s - tq / (s * s)) / (1 - tq / (s * s)), 6) AS "Kappa", round((c * s - tq) / sqrt((s * s - qq) * (s * s - tt)), 6) AS "MCC" FROM tot"""


for _avg in _AVG:

    @query({"macro": "g5_scores_macro", "weighted": "g3_scores_weighted", "micro": "g3_scores_micro"}[_avg], _cls_sql(_avg))
    def _(spark, d, avg=_avg):
        return _round(metrics.classification_scores(predictions(spark, d), "y", "p", avg))


@query("g1_accuracy", f"WITH {PRED} SELECT l_linestatus, round(avg((y = p)::INTEGER), 6) AS \"Accuracy\" FROM pred GROUP BY 1")
def _(spark, d):
    return _round(metrics.classification_scores(predictions(spark, d), "y", "p", by=["l_linestatus"]).select("l_linestatus", "Accuracy"))


@query("g2_auc_hard_labels", f"WITH {PRED}, {_CLS} SELECT round(avg((tp / t + 1 - (q - tp) / (s - t)) / 2), 6) AS \"AUC\" FROM cl")
def _(spark, d):
    return _round(metrics.scores(predictions(spark, d), "y", "p", "classification").select("AUC"))


@query("g4_kappa_mcc", f"""WITH {PRED}, {_CLS} SELECT round((c / s - tq / (s * s)) / (1 - tq / (s * s)), 6) AS "Kappa", round((c * s - tq) / sqrt((s * s - qq) * (s * s - tt)), 6) AS "MCC" FROM tot""")
def _(spark, d):
    return _round(metrics.classification_scores(predictions(spark, d), "y", "p").select("Kappa", "MCC"))


_FOLD_SCORES = f"fs AS (SELECT l_linenumber AS fold, l_linestatus AS rep, avg(abs(l_extendedprice - yhat)) AS a, sqrt(avg(pow(l_extendedprice - yhat, 2))) AS b FROM pred GROUP BY 1, 2)"


def _fold_scores(spark, d):
    s = metrics.regression_scores(predictions(spark, d), "l_extendedprice", "yhat", by=["l_linenumber", "l_linestatus"])
    s = s.withColumnsRenamed({"l_linenumber": "fold", "l_linestatus": "rep"}).persist()
    return s.select("rep", "fold", F.lit("first").alias("model"), F.col("MAE").alias("score")), s.select("rep", "fold", F.lit("second").alias("model"), F.col("RMSE").alias("score"))


@query("g6_mean_scores", f"WITH {PRED}, {_FOLD_SCORES} SELECT 'first' AS model, round(avg(a), 4) AS score FROM fs UNION ALL SELECT 'second', round(avg(b), 4) FROM fs")
def _(spark, d):
    a, b = _fold_scores(spark, d)
    return _round(metrics.mean_scores(a.unionByName(b), ["model"], ["score"]), 4)


@query("a13_model_spread", f"WITH {PRED}, {_FOLD_SCORES} SELECT 'first' AS model, round(avg(a), 4) AS mean, round(stddev_samp(a), 4) AS sd FROM fs UNION ALL SELECT 'second', round(avg(b), 4), round(stddev_samp(b), 4) FROM fs")
def _(spark, d):
    a, b = _fold_scores(spark, d)
    return _round(metrics.model_spread(a.unionByName(b), ["model"], "score"), 4)


@query(
    "t22_corrected_t_test",
    f"""WITH {PRED}, {_FOLD_SCORES}, s AS (SELECT avg(a - b) AS m, var_pop(a - b) AS v, count(*)::DOUBLE AS n FROM fs), t AS (SELECT m / sqrt(v * (1 / n + 1.0::DOUBLE / 6)) AS t, n FROM s)
SELECT round(t, 4) AS t_statistic, n - 1 AS df, round(abs(2 * t) / sqrt(n - 1), 4) AS cohens_d FROM t""",
)
def _(spark, d):
    a, b = _fold_scores(spark, d)
    return metrics.corrected_t_test(a, b, "score", folds=7).select(F.round("t_statistic", 4).alias("t_statistic"), "df", F.round("cohens_d", 4).alias("cohens_d"))


@query("x3_tail_probabilities")
def _(spark, d):
    from lakelens.operators import associations as assoc

    j = joined(spark, d)
    a = assoc.chi2_test(j, ["l_returnflag", "o_orderstatus", "c_mktsegment"]).select("var_1", "var_2", F.lit("chi2").alias("test"), "p_value")
    b = assoc.correlation_ratio(j, ["c_mktsegment"], ["l_quantity"]).select("var_1", "var_2", F.lit("f").alias("test"), "p_value")
    c = assoc.pearson(j, ["l_quantity", "l_tax"]).select("var_1", "var_2", F.lit("t").alias("test"), "p_value")
    return a.unionByName(b).unionByName(c)


@query("g8_trial_slices", f"SELECT trial, param, param_value, value FROM (SELECT trial, unnest(['decade', 'month']) AS param, unnest([((trial // 120)::BIGINT)::VARCHAR, (trial % 12)::VARCHAR]) AS param_value, value FROM ({_MONTHS}))")
def _(spark, d):
    t = _months(spark, d)
    params = F.create_map(F.lit("decade"), F.floor(F.col("trial") / 120).cast("string"), F.lit("month"), (F.col("trial") % 12).cast("string"))
    return metrics.trial_slices(t.withColumn("params", params))


# ---------------------------------------------------------------- evaluation tables


@query("e1_confusion", f"""WITH {PRED}, c AS (SELECT DISTINCT y FROM pred) SELECT a.y AS "true", b.y AS pred, (SELECT count(*) FROM pred WHERE pred.y = a.y AND pred.p = b.y) AS n FROM c a, c b""")
def _(spark, d):
    return evaluate.confusion_full(predictions(spark, d), "y", "p")


@query("e2_prediction_counts", f"""WITH {PRED} SELECT ['A','N','R'][y + 1] AS "true", ['A','N','R'][p + 1] AS pred, count(*) AS n FROM pred GROUP BY 1, 2""")
def _(spark, d):
    return evaluate.prediction_counts(predictions(spark, d), "y", "p", ["A", "N", "R"])


@query(
    "e3_class_report",
    f"""WITH {PRED}, {_CLS} SELECT c AS "class", round(tp / q, 6) AS precision, round(tp / t, 6) AS recall, round(2 * tp / (t + q), 6) AS f1, t::BIGINT AS support FROM cl""",
)
def _(spark, d):
    return _round(metrics.class_report(predictions(spark, d), "y", "p"))


_PTS = f"""{PRED}, sc AS (SELECT s AS score, sum(b) AS pos, sum(1 - b) AS neg FROM pred GROUP BY 1),
pts AS (SELECT score, pos::DOUBLE AS pos, neg::DOUBLE AS neg, (sum(pos) OVER (ORDER BY score DESC))::DOUBLE AS tp, (sum(neg) OVER (ORDER BY score DESC))::DOUBLE AS fp,
 (SELECT sum(pos) FROM sc)::DOUBLE AS P, (SELECT sum(neg) FROM sc)::DOUBLE AS N FROM sc)"""


def points(spark, d):
    return evaluate.threshold_table(predictions(spark, d), "b", {1: F.col("s")})


@query("e4_roc_curve", f"WITH {_PTS} SELECT score, round(fp / N, 6) AS fpr, round(tp / P, 6) AS tpr FROM pts")
def _(spark, d):
    return _round(evaluate.roc_curve(points(spark, d)).select("score", "fpr", "tpr"), 6, "fpr", "tpr")


@query("e4_roc_auc", f"WITH {_PTS}, a AS (SELECT round(sum(neg / N * (tp - pos / 2) / P), 6) AS auc FROM pts) SELECT '1' AS \"class\", auc FROM a UNION ALL SELECT 'macro', auc FROM a")
def _(spark, d):
    return _round(evaluate.roc_auc(points(spark, d)))


def _multi_sql(label, i):
    return f"SELECT '{label}' AS cls, CASE WHEN p = {i} THEN 0.5 + s / 2 ELSE s / 2 END AS score, CASE WHEN y = {i} THEN 1 ELSE 0 END AS hit FROM pred"


@query(
    "e4_roc_auc_multiclass",
    f"""WITH {PRED}, lo AS ({_union(_multi_sql(k, i) for i, k in enumerate('ANR'))}), al AS (SELECT * FROM lo UNION ALL SELECT 'micro', score, hit FROM lo),
r AS (SELECT cls, hit, rank() OVER (PARTITION BY cls ORDER BY score) + (count(*) OVER (PARTITION BY cls, score) - 1) / 2.0::DOUBLE AS rk FROM al),
a AS (SELECT cls, (sum(rk) FILTER (hit = 1) - sum(hit) * (sum(hit) + 1) / 2.0::DOUBLE) / (sum(hit)::DOUBLE * sum(1 - hit)) AS auc FROM r GROUP BY 1)
SELECT cls AS "class", round(auc, 6) AS auc FROM a UNION ALL SELECT 'macro', round(avg(auc), 6) FROM a WHERE cls <> 'micro'""",
)
def _(spark, d):
    df = predictions(spark, d)
    score_of = {k: F.when(F.col("p") == i, 0.5 + F.col("s") / 2).otherwise(F.col("s") / 2) for i, k in enumerate("ANR")}
    return _round(evaluate.roc_auc(evaluate.threshold_table(df, "l_returnflag", score_of, micro=True)))


@query("e5_precision_recall", f"WITH {_PTS} SELECT score, round(tp / (tp + fp), 6) AS precision, round(tp / P, 6) AS recall FROM pts")
def _(spark, d):
    return _round(evaluate.precision_recall_curve(points(spark, d)).drop("class"), 6, "precision", "recall")


@query("e5_average_precision", f"WITH {_PTS} SELECT round(sum(pos / P * tp / (tp + fp)), 6) AS average_precision FROM pts")
def _(spark, d):
    return _round(evaluate.average_precision(points(spark, d)).drop("class"))


@query("e6_calibration", f"WITH {PRED} SELECT least(floor(s * 5), 4)::INTEGER AS bin, count(*) AS n, round(avg(s), 6) AS mean_predicted, round(avg(b), 6) AS observed FROM pred GROUP BY 1")
def _(spark, d):
    return _round(evaluate.calibration(predictions(spark, d), F.col("b"), F.col("s")))


@query("e7_gain_e8_lift", f"WITH {_PTS} SELECT score, round((tp + fp) / (P + N), 6) AS share, round(tp / P, 6) AS gain, round(tp / P / ((tp + fp) / (P + N)), 6) AS lift FROM pts")
def _(spark, d):
    return _round(evaluate.gain_curve(points(spark, d)).drop("class"), 6, "share", "gain", "lift")


@query("e9_ks_statistic", f"WITH {_PTS}, g AS (SELECT score, abs(tp / P - fp / N) AS gap FROM pts) SELECT round(gap, 6) AS ks, score AS threshold FROM g ORDER BY gap DESC, score DESC LIMIT 1")
def _(spark, d):
    return _round(evaluate.ks_statistic(points(spark, d)).drop("class"), 6, "ks")


@query(
    "e10_threshold_curve",
    f"""WITH {PRED}, g AS (SELECT range::INTEGER AS k FROM range(101)), c AS (SELECT k, sum(b)::DOUBLE AS tp, sum(1 - b)::DOUBLE AS fp FROM g JOIN pred ON floor(s * 100) >= k GROUP BY k),
t AS (SELECT sum(b)::DOUBLE AS P, count(*)::DOUBLE AS N FROM pred)
SELECT k / 100.0::DOUBLE AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / P, 6) AS recall, round(2 * tp / (tp + fp + P), 6) AS f1, round((tp + fp) / N, 6) AS queue_rate FROM c, t""",
)
def _(spark, d):
    return _round(evaluate.threshold_curve(points(spark, d)).drop("class"), 6, "precision", "recall", "f1", "queue_rate")


@query(
    "e12_prediction_error",
    f"""WITH {PRED} SELECT round(regr_slope(yhat, l_extendedprice), 6) AS slope, round(regr_intercept(yhat, l_extendedprice), 3) AS intercept,
 round(1 - avg(pow(l_extendedprice - yhat, 2)) / var_pop(l_extendedprice), 6) AS r2, count(*) AS n FROM pred""",
)
def _(spark, d):
    e = evaluate.prediction_error(predictions(spark, d), "l_extendedprice", "yhat")
    return e.select(F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@query(
    "e13_residual_quartiles",
    f"""WITH {PRED} SELECT l_linestatus AS "group", round(quantile_cont(l_extendedprice - yhat, 0.25), 4) AS q1, round(median(l_extendedprice - yhat), 4) + 0.0 AS median,
 round(quantile_cont(l_extendedprice - yhat, 0.75), 4) AS q3 FROM pred GROUP BY 1""",
)
def _(spark, d):
    res = evaluate.residuals(predictions(spark, d), "l_extendedprice", "yhat")
    return _round(charts.box_summary(res, "residual", "l_linestatus").select("group", "q1", "median", "q3"), 4)


@query("m6_test_scores", f"WITH {PRED}, te AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {_order(', '.join(LINE_ID), 123)}) / (count(*) OVER (PARTITION BY l_returnflag))::DOUBLE <= 0.8::DOUBLE AS is_train FROM pred) SELECT is_train, round(avg((y = p)::INTEGER), 6) AS \"Accuracy\" FROM te GROUP BY 1")
def _(spark, d):
    df = split.train_test_split(predictions(spark, d), "l_returnflag", LINE_ID)
    return _round(metrics.classification_scores(df, "y", "p", by=["is_train"]).select("is_train", "Accuracy"))
