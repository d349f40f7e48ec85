"""Scans, projections, reshaping, aggregates, alerts and associations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lakelens.functions.columns import clean_names, complete_rows, number, r, roles, strip_prefix
from lakelens.functions.text import clean_text, merged_values, percent_text
from lakelens.operators import associations as assoc
from lakelens.operators import profile, reshape
from lakelens.operators.metrics import with_absolute
from lakelens.plans.session import checkpoint_root
from lakelens.registry.base import GAPS, JOINED, joined, query, with_gaps
from lakelens.sources.io import infer_timestamps, narrow_numbers, read_csv, table, write_table

NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ALL_NUMS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *NUMS]
LINE_COLS = [*ALL_NUMS, "l_returnflag", "l_linestatus", "l_shipdate"]


def _union(parts):
    return " UNION ALL ".join(parts)


# ---------------------------------------------------------------- sources


def _round_trip(spark, d, fmt):
    path = f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"
    write_table(table(spark, d, "orders"), path, fmt)
    return read_csv(spark, path) if fmt == "csv" else spark.read.parquet(path)


_ORDERS_FACTS = """SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers,
  min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders GROUP BY o_orderpriority"""


def _orders_facts(df):
    return df.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.count_distinct("o_custkey").alias("customers"),
        F.min("o_orderdate").cast("timestamp_ntz").alias("first_day"),
        F.max("o_orderdate").cast("timestamp_ntz").alias("last_day"),
    )


@query("s1_csv_scan", _ORDERS_FACTS)
def _(spark, d):
    return _orders_facts(_round_trip(spark, d, "csv"))


@query(
    "s2_infer_timestamps",
    """SELECT o_orderkey, o_orderdate AS day_text, substr(o_orderpriority, 1, 1) || '-' || o_orderstatus AS code FROM orders""",
)
def _(spark, d):
    text = table(spark, d, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day_text"),
        F.concat(F.substring("o_orderpriority", 1, 1), F.lit("-"), "o_orderstatus").alias("code"),
    )
    df = infer_timestamps(text)
    return df.withColumn("day_text", F.col("day_text").cast("timestamp_ntz"))


@query(
    "s3_narrow_numbers",
    """SELECT o_orderkey::INTEGER AS o_orderkey, o_totalprice::FLOAT::DOUBLE AS o_totalprice FROM orders""",
)
def _(spark, d):
    df = narrow_numbers(table(spark, d, "orders").select("o_orderkey", "o_totalprice"))
    return df.withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query("s4_csv_sink")
def _(spark, d):
    return _round_trip(spark, d, "csv").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"))


@query("s6_parquet_sink", _ORDERS_FACTS)
def _(spark, d):
    return _orders_facts(_round_trip(spark, d, "parquet"))


# ---------------------------------------------------------------- projections and filters


@query("p2_drop_time", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def _(spark, d):
    return reshape.drop_time_columns(table(spark, d, "orders"))


@query("p3_drop_missing_target", f"WITH {GAPS} SELECT count(*) AS n, round(avg(l_tax), 6) AS mean_tax FROM m WHERE l_tax IS NOT NULL")
def _(spark, d):
    return reshape.drop_missing_target(with_gaps(spark, d), "l_tax").agg(F.count("*").alias("n"), F.round(F.avg("l_tax"), 6).alias("mean_tax"))


@query("p4_listwise", f"WITH {GAPS} SELECT count(*) AS n, sum(l_quantity) AS q FROM m WHERE l_tax IS NOT NULL AND l_returnflag IS NOT NULL")
def _(spark, d):
    df = with_gaps(spark, d)
    return complete_rows(df, df.columns).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


@query("p5_identifier_columns", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, d):
    return reshape.drop_identifier_columns(table(spark, d, "customer"))[0]


@query(
    "p6_boolean_filters",
    """SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice >= 1000
  AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT (o_orderstatus = 'F' AND o_custkey = 0) GROUP BY o_orderstatus""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    keep = (F.col("o_orderstatus") != "P") & (F.col("o_totalprice") >= 1000) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return o.where(keep & ~((F.col("o_orderstatus") == "F") & (F.col("o_custkey") == 0))).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("p7_clean_names", "SELECT n_nationkey AS nation_key, n_name AS el_nombre, n_regionkey AS regionkey FROM nation")
def _(spark, d):
    return clean_names(table(spark, d, "nation").toDF("nation  key", "él ñombre!", "region-key"))


@query("p8_clean_values", r"SELECT doc_id, regexp_replace(strip_accents(text), '[^\p{L}\p{N}_]', '', 'g') AS cleaned FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", clean_text(F.col("text")).alias("cleaned"))


@query(
    "p8_merged_values",
    r"""WITH v AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '-') ELSE p_name END AS value, count(*) AS n FROM part GROUP BY 1)
SELECT regexp_replace(strip_accents(value), '[^\p{L}\p{N}_]', '', 'g') AS cleaned, count(*) AS n_values, sum(n)::BIGINT AS n_rows FROM v
GROUP BY 1 HAVING count(*) > 1""",
)
def _(spark, d):
    varied = F.when(F.col("p_partkey") % 3 == 0, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.col("p_name"))
    return merged_values(table(spark, d, "part").select(varied.alias("p_name")), "p_name")


@query(
    "p9_missing_indicators",
    f"""WITH {GAPS} SELECT CASE WHEN l_tax IS NULL THEN 'missing' ELSE 'present' END AS "Missing_in_l_tax",
  CASE WHEN l_returnflag IS NULL THEN 'missing' ELSE 'present' END AS "Missing_in_l_returnflag", count(*) AS n FROM m GROUP BY 1, 2""",
)
def _(spark, d):
    return reshape.missing_indicators(with_gaps(spark, d)).groupBy("Missing_in_l_tax", "Missing_in_l_returnflag").agg(F.count("*").alias("n"))


@query("p10_threshold_label", "SELECT event_id, coalesce(value >= 50, false) AS flagged FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", reshape.threshold_label(F.col("value"), 50.0).alias("flagged"))


@query("p11_cluster_text", "SELECT vec_id, 'Cluster ' || label AS cluster FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", reshape.cluster_text(F.col("label")).alias("cluster"))


@query("p12_coerce_numeric", "SELECT p_partkey, try_cast(replace(p_brand, 'Brand#', '') AS DOUBLE) AS a, try_cast(p_brand AS DOUBLE) AS b FROM part")
def _(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.replace("p_brand", F.lit("Brand#"), F.lit("")).alias("a"), F.col("p_brand").alias("b"))
    return reshape.coerce_numeric(part, ["a", "b"])


@query(
    "p14_high_low",
    """SELECT l_quantity_level, l_tax_level, count(*) AS n FROM (SELECT
  CASE WHEN l_quantity <= (SELECT avg(l_quantity) FROM lineitem) THEN 'low' ELSE 'high' END AS l_quantity_level,
  CASE WHEN l_tax <= (SELECT avg(l_tax) FROM lineitem) THEN 'low' ELSE 'high' END AS l_tax_level FROM lineitem) GROUP BY 1, 2""",
)
def _(spark, d):
    df = reshape.high_low(table(spark, d, "lineitem"), ["l_quantity", "l_tax"])
    return df.groupBy("l_quantity_level", "l_tax_level").agg(F.count("*").alias("n"))


@query(
    "p15_quantile_bins",
    """WITH q AS (SELECT quantile_cont(o_totalprice, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e FROM orders)
SELECT o_orderkey, len(list_filter((SELECT e FROM q), lambda v: v < o_totalprice))::INTEGER AS bin FROM orders""",
)
def _(spark, d):
    return reshape.quantile_bin(table(spark, d, "orders"), "o_totalprice", 10).select("o_orderkey", "bin")


@query("p16_strip_prefix", "SELECT s_suppkey AS suppkey, s_name AS name, s_nationkey AS nationkey, s_acctbal AS acctbal FROM supplier")
def _(spark, d):
    return strip_prefix(table(spark, d, "supplier"), "s_")


@query(
    "p17_run_keys",
    """SELECT o_orderstatus, count(*) AS n, 2 AS rep, 3 AS fold FROM orders GROUP BY o_orderstatus""",
)
def _(spark, d):
    return reshape.add_run_keys(table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")), run=8, folds=5)


@query(
    "p19_absolute_scores",
    "SELECT c_mktsegment, round(min(c_acctbal), 2) AS low, round(abs(min(c_acctbal)), 2) AS abs_low FROM customer GROUP BY c_mktsegment",
)
def _(spark, d):
    per = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.min("c_acctbal"), 2).alias("low"))
    return with_absolute(per, ["low"])


@query("p20_choose_columns", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority")


# ---------------------------------------------------------------- joins and reshaping


@query(
    "j1_attach_scores",
    "SELECT o_orderkey, round(o_totalprice / (SELECT max(o_totalprice) FROM orders), 6) AS score, o_orderstatus FROM orders",
)
def _(spark, d):
    o = table(spark, d, "orders")
    top = o.agg(F.max("o_totalprice")).first()[0]
    scores = o.select("o_orderkey", F.round(F.col("o_totalprice") / F.lit(top), 6).alias("score"))
    return scores.join(o.select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query("j5_attach_statistics", "SELECT c_custkey, round(c_acctbal - (SELECT median(c_acctbal) FROM customer), 4) + 0.0 AS off_median FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    med = profile.exact_quantiles(c, ["c_acctbal"], [0.5])["c_acctbal"][0]
    return c.select("c_custkey", r(F.col("c_acctbal") - F.lit(med), 4).alias("off_median"))


@query("u1_drop_duplicates", "SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem")
def _(spark, d):
    return reshape.drop_duplicates(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_discount"))


@query(
    "u2_duplicate_count",
    """SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag FROM lineitem)) AS n_duplicates,
  round(100.0 * (count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag FROM lineitem))) / count(*), 6)::DOUBLE AS pct FROM lineitem""",
)
def _(spark, d):
    df = reshape.duplicate_count(table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag"))
    return df.withColumn("pct", F.round("pct", 6))


@query(
    "u3_union_results",
    """SELECT 'customer' AS source, count(*) AS n, round(avg(c_acctbal), 4) AS balance, NULL::DOUBLE AS price FROM customer UNION ALL
SELECT 'part', count(*), NULL, round(avg(p_retailprice), 4) FROM part""",
)
def _(spark, d):
    a = table(spark, d, "customer").agg(F.lit("customer").alias("source"), F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("balance"))
    b = table(spark, d, "part").agg(F.lit("part").alias("source"), F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price"))
    return reshape.stack_results([a, b])


@query(
    "u4_melt",
    _union(f"SELECT p_partkey, '{c}' AS variable, {c}::DOUBLE AS value FROM part" for c in ("p_size", "p_retailprice")),
)
def _(spark, d):
    return reshape.melt(table(spark, d, "part"), ["p_partkey"], ["p_size", "p_retailprice"])


@query(
    "u5_cross_table",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
  count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY o_orderpriority""",
)
def _(spark, d):
    return reshape.cross_table(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query(
    "u6_transpose_row",
    _union(f"SELECT '{a}' AS fact, ({e})::DOUBLE AS value FROM events" for a, e in (("n", "count(*)"), ("users", "count(DISTINCT user_id)"), ("top", "max(value)"))),
)
def _(spark, d):
    row = table(spark, d, "events").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.max("value").alias("top"))
    return reshape.transpose_row(row)


# ---------------------------------------------------------------- profile

_MAD = """med AS (SELECT {med} FROM c), dev AS (SELECT {dev} FROM c, med), mad AS (SELECT {mad} FROM dev),
mo AS ({rows})"""


def mad_ctes(source: str, cols: list[str]) -> str:
    """CTEs ending in mo(variable, n, median, mad, n_outliers) over complete rows of ``source``."""
    where = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    med = ", ".join(f"median({c}::DOUBLE) AS med_{c}" for c in cols)
    dev = ", ".join(f"abs({c}::DOUBLE - med_{c}) AS {c}" for c in cols)
    mad = ", ".join(f"median({c}) AS mad_{c}" for c in cols)
    rows = _union(
        f"""SELECT '{c}' AS variable, count(*) AS n, any_value(med_{c}) AS median, any_value(mad_{c}) AS mad,
  count(*) FILTER (CASE WHEN mad_{c} = 0 THEN {c} > 0 ELSE 0.6745::DOUBLE * {c} / mad_{c} > 3.5 END) AS n_outliers FROM dev, mad, med"""
        for c in cols
    )
    return f"c AS (SELECT * FROM {source} WHERE {where}), " + _MAD.format(med=med, dev=dev, mad=mad, rows=rows)


def missing_sql(source: str, cols: list[str]) -> str:
    return _union(
        f"SELECT '{c}' AS variable, count(*) FILTER ({c} IS NULL) AS n_missing, round(100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*), 6) AS pct FROM {source}"
        for c in cols
    )


def _overview_sql(source: str, prelude: str, cols: list[str], nums: list[str], n_cat: int, n_time: int) -> str:
    w = len(cols)
    miss = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in cols)
    facts = [
        ("Number of observations", f"n * {w} - miss", None),
        ("Number of rows", "n", None),
        ("Number of variables", str(w), None),
        ("Number of categorical variables", str(n_cat), None),
        ("Number of numerical variables", str(len(nums)), None),
        ("Number of date or datetime variables", str(n_time), None),
        ("Number of missing cells", "miss", None),
        ("Missing cells (%)", f"100.0::DOUBLE * miss / (n * {w})", 1),
        ("Number of duplicated rows", "dup", None),
        ("Duplicated rows (%)", "100.0::DOUBLE * dup / n", 1),
        ("Number of univariate outliers", "outl", None),
        ("Univariate outliers (%)", f"100.0::DOUBLE * outl / (n * {w})", 1),
    ]
    rows = _union(
        f"SELECT {i} AS position, '{f}' AS fact, round(({e})::DOUBLE, 6) AS value, "
        + (f"printf('%.1f%%', {e})" if pct else f"(({e})::BIGINT)::VARCHAR")
        + " AS text FROM b"
        for i, (f, e, pct) in enumerate(facts, 1)
    )
    return f"""WITH {prelude}{mad_ctes(source, nums)}, b AS (SELECT (SELECT count(*) FROM {source}) AS n, (SELECT {miss} FROM {source}) AS miss,
 (SELECT count(*) FROM {source}) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(cols)} FROM {source})) AS dup, (SELECT sum(n_outliers) FROM mo) AS outl) {rows}"""


def _overview(df):
    return profile.overview(df).withColumn("value", F.round("value", 6))


@query("a1_overview", _overview_sql("lineitem", "", LINE_COLS, ALL_NUMS, 2, 1))
def _(spark, d):
    return _overview(table(spark, d, "lineitem"))


@query("a1_overview_with_gaps", _overview_sql("m", GAPS + ", ", LINE_COLS, ALL_NUMS, 2, 1))
def _(spark, d):
    return _overview(with_gaps(spark, d))


@query("a2_missing_cells", f"WITH {GAPS} " + missing_sql("m", LINE_COLS))
def _(spark, d):
    return profile.missing_per_column(with_gaps(spark, d)).withColumn("pct", F.round("pct", 6))


@query(
    "a3_value_counts",
    f"WITH {GAPS} " + _union(f"SELECT '{c}' AS variable, {c} AS value, count(*) AS n FROM m WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("l_returnflag", "l_linestatus")),
)
def _(spark, d):
    return profile.value_counts(with_gaps(spark, d))


@query(
    "a4_distinct_counts",
    f"WITH {GAPS} " + _union(f"SELECT '{c}' AS variable, count(DISTINCT {c}) AS n_unique, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_distinct FROM m" for c in LINE_COLS),
)
def _(spark, d):
    return profile.distinct_counts(with_gaps(spark, d))


def _describe_sql(source, cols):
    return _union(
        f"""SELECT '{c}' AS variable, count({c}) AS "count", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min,
 round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75, max({c})::DOUBLE AS max FROM {source}"""
        for c in cols
    )


@query("a5_describe_numeric", f"WITH {GAPS} " + _describe_sql("m", ALL_NUMS))
def _(spark, d):
    df = profile.describe_numeric(with_gaps(spark, d))
    return df.withColumns({**{c: F.round(c, 4) for c in ("mean", "std")}, **{c: F.round(c, 6) for c in ("q25", "q50", "q75")}})


_CAT_SQL = """SELECT '{c}' AS variable, sum(n)::BIGINT AS "count", count(*) AS "unique", (SELECT {c} FROM v_{c} ORDER BY n DESC, {c} LIMIT 1) AS top, max(n) AS freq FROM v_{c}"""


@query(
    "a6_describe_categorical",
    f"WITH {GAPS}, "
    + ", ".join(f"v_{c} AS (SELECT {c}, count(*) AS n FROM m WHERE {c} IS NOT NULL GROUP BY {c})" for c in ("l_returnflag", "l_linestatus"))
    + " "
    + _union(_CAT_SQL.format(c=c) for c in ("l_returnflag", "l_linestatus")),
)
def _(spark, d):
    return profile.describe_categorical(with_gaps(spark, d))


@query("a7_grouped_means", f"""WITH {JOINED} SELECT c_mktsegment, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount,
 round(avg(o_totalprice), 4) AS o_totalprice FROM j GROUP BY c_mktsegment""")
def _(spark, d):
    return joined(spark, d).groupBy("c_mktsegment").agg(
        F.round(F.avg("l_quantity"), 6).alias("l_quantity"), F.round(F.avg("l_discount"), 6).alias("l_discount"), F.round(F.avg("o_totalprice"), 4).alias("o_totalprice")
    )


@query("a8_two_column_counts", f"WITH {GAPS} SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM m WHERE l_returnflag IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return reshape.contingency(with_gaps(spark, d), "l_returnflag", "l_linestatus")


@query("a9_mad_outliers", f"WITH {GAPS}, {mad_ctes('m', ALL_NUMS)} SELECT variable, n, round(median, 6) AS median, round(mad, 6) AS mad, n_outliers FROM mo")
def _(spark, d):
    return profile.mad_outliers(with_gaps(spark, d)).withColumns({c: F.round(c, 6) for c in ("median", "mad")})


@query("a9_mad_outliers_events", f"WITH {mad_ctes('events', ['value'])} SELECT variable, n, round(median, 6) AS median, round(mad, 6) AS mad, n_outliers FROM mo")
def _(spark, d):
    return profile.mad_outliers(table(spark, d, "events"), columns=["value"]).withColumns({c: F.round(c, 6) for c in ("median", "mad")})


@query("a10_overall_means", f"WITH {GAPS} " + _union(f"SELECT '{c}' AS variable, round(avg({c}), 4) AS mean FROM m" for c in ALL_NUMS))
def _(spark, d):
    from lakelens.operators.charts import overall_means

    return overall_means(with_gaps(spark, d), ALL_NUMS).withColumn("mean", F.round("mean", 4))


# ---------------------------------------------------------------- alerts


def _moments_sql(source, cols):
    """CTE z(variable, n, skewness, skew_z, kurtosis, kurtosis_z) spelled out from central moments."""
    mom = _union(
        f"""SELECT '{c}' AS variable, count({c})::DOUBLE AS n, avg(pow({c} - mu, 3)) / pow(avg(pow({c} - mu, 2)), 1.5) AS sk,
 avg(pow({c} - mu, 4)) / pow(avg(pow({c} - mu, 2)), 2) - 3 AS ku FROM {source}, (SELECT avg({c}) AS mu FROM {source})"""
        for c in cols
    )
    return f"""mom AS ({mom}), z1 AS (SELECT *, sk * sqrt((n+1)*(n+3)/(6*(n-2))) AS y,
 sqrt(2*(3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) - 1)) - 1 AS w2,
 (ku + 3 - 3*(n-1)/(n+1)) / sqrt(24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5))) AS x,
 6*(n*n-5*n+2)/((n+7)*(n+9)) * sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS b1 FROM mom),
z2 AS (SELECT *, 6 + 8/b1*(2/b1 + sqrt(1 + 4/(b1*b1))) AS a, y / sqrt(2/(w2-1)) AS ya FROM z1),
z AS (SELECT variable, n::BIGINT AS n, sk AS skewness, ln(ya + sqrt(ya*ya+1)) / sqrt(0.5*ln(w2)) AS skew_z, ku AS kurtosis,
 (1 - 2/(9*a) - sign(1 + x*sqrt(2/(a-4))) * cbrt((1 - 2/a) / abs(1 + x*sqrt(2/(a-4))))) / sqrt(2/(9*a)) AS kurtosis_z FROM z2)"""


@query("t8_kurtosis_test", f"WITH {GAPS}, {_moments_sql('m', NUMS)} SELECT variable, n, round(kurtosis, 6) AS kurtosis, round(kurtosis_z, 4) AS kurtosis_z FROM z")
def _(spark, d):
    return profile.normality(with_gaps(spark, d), NUMS).select("variable", "n", F.round("kurtosis", 6).alias("kurtosis"), F.round("kurtosis_z", 4).alias("kurtosis_z"))


@query("t9_skewness_test", f"WITH {_moments_sql('events', ['value'])} SELECT variable, n, round(skewness, 6) AS skewness, round(skew_z, 4) AS skew_z FROM z")
def _(spark, d):
    return profile.normality(table(spark, d, "events"), ["value"]).select("variable", "n", F.round("skewness", 6).alias("skewness"), F.round("skew_z", 4).alias("skew_z"))


_BAL = """SELECT '{c}' AS variable, round(-sum(n / t * ln(n / t)) / ln(count(*)), 6) AS balance, count(*) AS n_distinct FROM
 (SELECT {c}, count(*)::DOUBLE AS n, (SELECT count(*) FROM {s}) AS t FROM {s} GROUP BY {c})"""


@query(
    "t10_shannon_balance",
    f"WITH {GAPS}, {JOINED} "
    + _union([_BAL.format(c=c, s="m") for c in ("l_returnflag", "l_linestatus")] ),
)
def _(spark, d):
    return profile.category_facts(with_gaps(spark, d)).select("variable", F.round("balance", 6).alias("balance"), "n_distinct")


@query("t11_alert_constant", "SELECT 'doc_kind' AS variable, 'text' AS value")
def _(spark, d):
    return profile.constant_columns(table(spark, d, "documents").withColumn("doc_kind", F.lit("text")))


def _alerts_of(df, *names):
    return profile.alerts(df).where(F.col("Alert").isin(*names))


@query(
    "t13_alert_missing",
    f"""WITH {GAPS}, x AS ({missing_sql('m', LINE_COLS)}) SELECT variable AS "Variable", 'Missing Values' AS "Alert",
 'Column has ' || n_missing || ' missing values (' || printf('%.1f', pct) || '%)' AS "Detail" FROM x WHERE n_missing > 0""",
)
def _(spark, d):
    return _alerts_of(with_gaps(spark, d), "Missing Values").select("Variable", "Alert", "Detail")


def _cat_alert_sql(source, cols):
    return _union(
        f"""SELECT '{c}' AS variable, count(*) AS nd, (SELECT count(*) FROM {source}) AS nr, CASE WHEN count(*) > 1 THEN -sum(n / t * ln(n / t)) / ln(count(*)) END AS bal FROM
 (SELECT {c}, count(*)::DOUBLE AS n, (SELECT count(*) FROM {source}) AS t FROM {source} GROUP BY {c})"""
        for c in cols
    )


_CUST = f"x AS ({_cat_alert_sql('customer', ['c_name', 'c_mktsegment'])})"


@query("t14_alert_cardinality", f"WITH {_CUST} SELECT variable AS \"Variable\", 'Column has ' || nd || ' distinct values' AS \"Detail\" FROM x WHERE nd > 50")
def _(spark, d):
    return _alerts_of(table(spark, d, "customer"), "Cardinality").select("Variable", "Detail")


@query(
    "t15_alert_imbalanced",
    f"WITH {GAPS}, x AS ({_cat_alert_sql('m', ['l_returnflag', 'l_linestatus'])}) SELECT variable AS \"Variable\", round(bal, 6) AS stat FROM x WHERE bal < 0.95",
)
def _(spark, d):
    return _alerts_of(with_gaps(spark, d), "Imbalanced").select("Variable", F.round("stat", 6).alias("stat"))


@query("t16_alert_unique", f"WITH {_CUST} SELECT variable AS \"Variable\", 'All values of the column are unique' AS \"Detail\" FROM x WHERE nd = nr")
def _(spark, d):
    return _alerts_of(table(spark, d, "customer"), "Unique Values").select("Variable", "Detail")


_Z = "1.959963984540054"


@query(
    "t17_alert_normality",
    f"""WITH {_moments_sql('lineitem', ALL_NUMS)} SELECT variable AS "Variable", 'Kurtosis' AS "Alert", round(kurtosis_z, 2) AS stat FROM z WHERE abs(kurtosis_z) > {_Z}
UNION ALL SELECT variable, 'Skewness', round(skew_z, 2) FROM z WHERE abs(skew_z) > {_Z}""",
)
def _(spark, d):
    return _alerts_of(table(spark, d, "lineitem"), "Kurtosis", "Skewness").select("Variable", "Alert", F.round("stat", 2).alias("stat"))


@query(
    "t18_alert_infinite",
    """SELECT 'ratio' AS "Variable", count(*) FILTER (l_discount = 0) AS n, round(100.0::DOUBLE * count(*) FILTER (l_discount = 0) / count(*), 6) AS pct FROM lineitem HAVING count(*) FILTER (l_discount = 0) > 0""",
)
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_tax") / F.when(F.col("l_discount") != 0, F.col("l_discount"))).alias("ratio"))
    return profile.infinite_counts(li).where("n_infinite > 0").select(F.col("variable").alias("Variable"), F.col("n_infinite").alias("n"), F.round("pct", 6).alias("pct"))


@query("t19_alert_outliers", f"WITH {mad_ctes('events', ['event_id', 'user_id', 'value'])} SELECT variable AS \"Variable\", n_outliers AS n FROM mo WHERE n_outliers > 0")
def _(spark, d):
    return _alerts_of(table(spark, d, "events"), "Outliers").select("Variable", "n")


@query("t20_alert_date", """SELECT 'l_shipdate' AS "Variable", 'Date' AS "Alert" """)
def _(spark, d):
    return _alerts_of(table(spark, d, "lineitem"), "Date").select("Variable", "Alert")


# ---------------------------------------------------------------- associations


def _pearson_sql(source, cols):
    return _union(f"SELECT '{a}' AS var_1, '{b}' AS var_2, corr({a}, {b}) AS value FROM {source}" for i, a in enumerate(cols) for b in cols[i:])


@query("t2_pearson", f"WITH x AS ({_pearson_sql('lineitem', NUMS)}) SELECT var_1, var_2, round(value, 6) + 0.0 AS value FROM x")
def _(spark, d):
    return assoc.pearson(table(spark, d, "lineitem"), NUMS).select("var_1", "var_2", r(F.col("value")).alias("value"))


def rank_sql(c):
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE)"


def _spearman_sql(source, cols):
    ranks = f"rk AS (SELECT {', '.join(f'{rank_sql(c)} AS {c}' for c in cols)} FROM {source})"
    return ranks, _pearson_sql("rk", cols)


_SP = _spearman_sql("lineitem", NUMS)


@query("t3_spearman", f"WITH {_SP[0]}, x AS ({_SP[1]}) SELECT var_1, var_2, round(value, 6) + 0.0 AS value FROM x")
def _(spark, d):
    return assoc.spearman(table(spark, d, "lineitem"), NUMS).select("var_1", "var_2", r(F.col("value")).alias("value"))


CATS = ["l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority", "c_mktsegment"]


def _cont_sql(source, cols):
    """CTE ct(var_1, var_2, n, r, k, chi2)."""
    one = _union(
        f"""SELECT '{a}' AS var_1, '{b}' AS var_2, sum(n) AS n, (SELECT count(DISTINCT {a}) FROM {source})::DOUBLE AS r, (SELECT count(DISTINCT {b}) FROM {source})::DOUBLE AS k,
 greatest(sum(n) * (sum(n / na * (n / nb)) - 1), 0) AS chi2 FROM (SELECT a, b, count(*)::DOUBLE AS n FROM (SELECT {a} AS a, {b} AS b FROM {source}) GROUP BY a, b)
 JOIN (SELECT {a} AS a, count(*)::DOUBLE AS na FROM {source} GROUP BY 1) USING (a) JOIN (SELECT {b} AS b, count(*)::DOUBLE AS nb FROM {source} GROUP BY 1) USING (b)"""
        for i, a in enumerate(cols)
        for b in cols[i:]
    )
    return f"ct AS ({one})"


_CORR_V = """CASE WHEN least(r - (r-1)*(r-1)/(n-1), k - (k-1)*(k-1)/(n-1)) - 1 = 0 THEN 0 ELSE
 sqrt(greatest(0, chi2/n - (k-1)*(r-1)/(n-1)) / (least(r - (r-1)*(r-1)/(n-1), k - (k-1)*(k-1)/(n-1)) - 1)) END"""


def _cont(df, cols):
    return df.select(*cols)


@query("t4_cramers_v", f"WITH {JOINED}, {_cont_sql('j', CATS)} SELECT var_1, var_2, round({_CORR_V}, 6) + 0.0 AS value FROM ct")
def _(spark, d):
    return assoc.cramers_v(joined(spark, d), CATS).select("var_1", "var_2", r(F.col("value")).alias("value"))


@query(
    "t5_cramers_v_plain",
    f"WITH {JOINED}, {_cont_sql('j', CATS)} SELECT var_1, var_2, round(sqrt(chi2 / (n * (least(r, k) - 1))), 6) + 0.0 AS value FROM ct",
)
def _(spark, d):
    return assoc.cramers_v(joined(spark, d), CATS, corrected=False).select("var_1", "var_2", r(F.col("value")).alias("value"))


@query("t7_chi2", f"WITH {JOINED}, {_cont_sql('j', CATS)} SELECT var_1, var_2, round(chi2, 4) + 0.0 AS chi2, (r-1)*(k-1) AS dof FROM ct")
def _(spark, d):
    return assoc.chi2_test(joined(spark, d), CATS).select("var_1", "var_2", r(F.col("chi2"), 4).alias("chi2"), "dof")


def _eta_sql(source, cats, nums):
    return _union(
        f"""SELECT '{a}' AS var_1, '{b}' AS var_2, CASE WHEN count(*) < 2 THEN 0 ELSE sqrt(sum(n * pow(mu - gm, 2)) / any_value(sst)) END AS value,
 CASE WHEN count(*) < 2 THEN 0 ELSE (sum(n * pow(mu - gm, 2)) / (count(*) - 1)) / ((any_value(sst) - sum(n * pow(mu - gm, 2))) / (sum(n) - count(*))) END AS f
 FROM (SELECT {a}, count(*) AS n, avg({b}) AS mu FROM {source} GROUP BY {a}), (SELECT avg({b}) AS gm, var_pop({b}) * count(*) AS sst FROM {source})"""
        for a in cats
        for b in nums
    )


@query("t6_correlation_ratio", f"WITH {JOINED}, e AS ({_eta_sql('j', CATS, NUMS)}) SELECT var_1, var_2, round(value, 6) AS value, round(f, 4) AS f FROM e")
def _(spark, d):
    return assoc.correlation_ratio(joined(spark, d), CATS, NUMS).select("var_1", "var_2", F.round("value", 6).alias("value"), F.round("stat", 4).alias("f"))


# Associations of lineitem with gaps: modes are filled in first.
_A_NUM, _A_CAT = NUMS, ["l_returnflag", "l_linestatus"]
_FILLED = f"""{GAPS}, f AS (SELECT * REPLACE (coalesce(l_tax, (SELECT l_tax FROM m WHERE l_tax IS NOT NULL GROUP BY l_tax ORDER BY count(*) DESC, l_tax LIMIT 1)) AS l_tax,
 coalesce(l_returnflag, (SELECT l_returnflag FROM m WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1)) AS l_returnflag) FROM m)"""
_F_SP = _spearman_sql("f", _A_NUM)
_HALF = f"""half AS (SELECT var_1, var_2, 'spearman' AS kind, value FROM ({_F_SP[1]}) UNION ALL SELECT var_1, var_2, 'cramers_v', {_CORR_V} FROM ct
 UNION ALL SELECT var_1, var_2, 'correlation_ratio', value FROM ({_eta_sql('f', _A_CAT, _A_NUM)})),
full_a AS (SELECT * FROM half UNION ALL SELECT var_2, var_1, kind, value FROM half WHERE var_1 <> var_2)"""
_ASSOC = f"WITH {_FILLED}, {_F_SP[0]}, {_cont_sql('f', _A_CAT)}, {_HALF}"


@query("t1_associations", f"{_ASSOC} SELECT var_1, var_2, kind, round(value, 6) + 0.0 AS value FROM full_a")
def _(spark, d):
    df = with_gaps(spark, d).select(*_A_NUM, *_A_CAT)
    return assoc.associations(df).select("var_1", "var_2", "kind", r(F.col("value")).alias("value"))


@query(
    "c16_heat_map",
    f"{_ASSOC} SELECT var_1 AS variable, " + ", ".join(f"max(CASE WHEN var_2 = '{c}' THEN round(value, 6) + 0.0 END) AS {c}" for c in _A_NUM + _A_CAT) + " FROM full_a GROUP BY var_1",
)
def _(spark, d):
    long = assoc.associations(with_gaps(spark, d).select(*_A_NUM, *_A_CAT)).withColumn("value", r(F.col("value")))
    return assoc.to_matrix(long, _A_NUM + _A_CAT)


_T12_CATS, _T12_NUMS = ["l_returnflag", "o_orderstatus"], ["l_quantity", "l_extendedprice", "net"]


@query(
    "t12_alert_correlation",
    f"""WITH {JOINED.replace('j AS (SELECT *', 'j AS (SELECT *, l_extendedprice * (1 - l_discount) AS net')}, {_cont_sql('j', _T12_CATS)}, h AS ({_pearson_sql('j', _T12_NUMS)}
 UNION ALL SELECT var_1, var_2, value FROM ({_eta_sql('j', _T12_CATS, _T12_NUMS)}) UNION ALL SELECT var_1, var_2, {_CORR_V} FROM ct),
 b AS (SELECT * FROM h UNION ALL SELECT var_2, var_1, value FROM h)
SELECT var_1 AS "Variable", 'Highly correlated with ' || var_2 || ' ' || printf('%.2f', value) AS "Detail" FROM b WHERE var_1 <> var_2 AND abs(value) > 0.5""",
)
def _(spark, d):
    df = joined(spark, d).select("l_quantity", "l_extendedprice", "l_returnflag", "o_orderstatus", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    return profile.correlation_alerts(assoc.associations(df, "pearson")).select("Variable", "Detail")


@query("p18_lower_triangle", f"""{_ASSOC}, o AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(_A_NUM + _A_CAT))}) AS t(name, pos))
SELECT var_1, var_2, round(value, 6) + 0.0 AS value FROM full_a JOIN o a ON a.name = var_1 JOIN o b ON b.name = var_2 WHERE a.pos > b.pos""")
def _(spark, d):
    long = assoc.associations(with_gaps(spark, d).select(*_A_NUM, *_A_CAT))
    return reshape.lower_triangle(long, _A_NUM + _A_CAT).select("var_1", "var_2", r(F.col("value")).alias("value"))


@query("t21_alert_table")
def _(spark, d):
    df = with_gaps(spark, d).select(*_A_NUM, *_A_CAT, "l_shipdate")
    return profile.alerts(df, assoc.associations(df))


@query(
    "t23_missingness_associations",
    f"""WITH {GAPS}, mode_f AS (SELECT l_returnflag AS v FROM m WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
g AS (SELECT coalesce(l_returnflag, (SELECT v FROM mode_f)) AS l_returnflag, l_linestatus, l_quantity,
 CASE WHEN l_returnflag IS NULL THEN 'missing' ELSE 'present' END AS "Missing_in_l_returnflag" FROM m),
{_cont_sql('g', ['l_returnflag', 'l_linestatus', 'Missing_in_l_returnflag'])}, e AS ({_eta_sql('g', ['Missing_in_l_returnflag'], ['l_quantity'])})
SELECT var_2 AS var_1, var_1 AS var_2, round({_CORR_V}, 6) + 0.0 AS value FROM ct WHERE var_2 = 'Missing_in_l_returnflag' AND var_1 <> var_2
UNION ALL SELECT var_1, var_2, round(value, 6) + 0.0 FROM e""",
)
def _(spark, d):
    df = with_gaps(spark, d).select("l_quantity", "l_returnflag", "l_linestatus")
    return assoc.missingness_associations(df).select("var_1", "var_2", r(F.col("value")).alias("value"))


@query(
    "c19_variable_alerts",
    f"WITH {GAPS} SELECT 'l_returnflag' AS \"Variable\", 'Missing Values' AS \"Alert\", count(*) FILTER (l_returnflag IS NULL) AS n FROM m",
)
def _(spark, d):
    return profile.variable_alerts(profile.alerts(with_gaps(spark, d)), "l_returnflag").where("Alert = 'Missing Values'").select("Variable", "Alert", "n")


@query(
    "x1_number_text",
    "SELECT o_orderstatus, printf('%.1f', 100.0::DOUBLE * count(*) / (SELECT count(*) FROM orders)) || '%' AS share FROM orders GROUP BY o_orderstatus",
)
def _(spark, d):
    o = table(spark, d, "orders")
    n = o.count()
    return o.groupBy("o_orderstatus").agg(percent_text(100.0 * F.count("*") / F.lit(n)).alias("share"))


@query(
    "x4_math",
    """SELECT event_id, round(ln(value), 6) + 0.0 AS a, round(ln(1 + value), 6) AS b, round(sqrt(value), 6) AS c, round(cbrt(value), 6) AS d, round(abs(value - 50), 6) AS e FROM events""",
)
def _(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select(
        "event_id", r(F.ln(v)).alias("a"), F.round(F.log1p(v), 6).alias("b"), F.round(F.sqrt(v), 6).alias("c"), F.round(F.cbrt(v), 6).alias("d"), F.round(F.abs(v - 50), 6).alias("e")
    )
