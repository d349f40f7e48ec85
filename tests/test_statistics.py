"""Distributions, quantiles, ranks, alerts and associations on small tables with known answers."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakelens.functions import dist
from lakelens.functions.columns import clean_name, clean_names, roles
from lakelens.functions.text import clean_values
from lakelens.operators import associations, charts, profile, reshape
from lakelens.plans.quantiles import exact_quantiles, exact_quantiles_by
from lakelens.plans.ranking import average_rank_table, running_totals, shuffled_row_number, with_average_ranks
from lakelens.plans.session import lookup


def test_tail_probabilities_match_published_tables():
    assert dist.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert dist.t_two_sided(1.959963985, 1e9) == pytest.approx(0.05, abs=1e-8)
    assert dist.f_sf(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert dist.f_sf(2.978237016, 10, 10) == pytest.approx(0.05, abs=1e-9)
    assert dist.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert dist.chi2_sf(18.30703805, 10) == pytest.approx(0.05, abs=1e-9)
    assert dist.norm_cdf(1.959963984540054) == pytest.approx(0.975)
    assert dist.norm_ppf(0.975) == pytest.approx(1.959963984540054)


@settings(max_examples=50, deadline=None)
@given(st.floats(0.05, 50), st.floats(1, 60))
def test_t_and_f_agree(t, df):
    assert dist.t_two_sided(t, df) == pytest.approx(dist.f_sf(t * t, 1, df), abs=1e-12)


def numbers(spark, n=5000, parts=7, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.lognormal(size=n), 3)
    x[: n // 3] = 1.0  # one value holds a third of the rows
    rows = [(int(i), float(v), "a" if i % 3 else "b") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x double, g string").repartition(parts), x


@pytest.mark.parametrize("accuracy,inside", [(10_000, 1_000_000), (50, 100), (20, 40)])
def test_exact_quantiles_with_refinement(spark, accuracy, inside):
    df, x = numbers(spark)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, ["x"], probs, accuracy, inside)["x"]
    assert got == pytest.approx(list(np.quantile(x, probs)))
    by = {r["g"]: r["q"] for r in exact_quantiles_by(df, ["g"], "x", probs, accuracy, inside).collect()}
    for g, keep in (("a", np.arange(len(x)) % 3 != 0), ("b", np.arange(len(x)) % 3 == 0)):
        assert by[g] == pytest.approx(list(np.quantile(x[keep], probs)))


def test_quantiles_of_missing_values(spark):
    df = spark.createDataFrame([(None, float("nan")), (None, 2.0), (None, 4.0)], "e double, x double")
    got = exact_quantiles(df, ["e", "x"], [0.5])
    assert got == {"e": [None], "x": [3.0]}


@pytest.mark.parametrize("ranges", [None, 5, 200])
def test_running_totals_any_number_of_ranges(spark, ranges):
    df, x = numbers(spark)
    counts = df.groupBy("x").agg(F.count("*").alias("n"))
    got = [(r["x"], r["n_cum"]) for r in running_totals(counts, "x", ["n"], ranges=ranges).orderBy("x").collect()]
    v, c = np.unique(x, return_counts=True)
    assert got == list(zip(v.tolist(), np.cumsum(c).tolist()))
    down = {r["x"]: r["n_cum"] for r in running_totals(counts, "x", ["n"], descending=True, ranges=ranges).collect()}
    assert down[v[0]] == len(x) and down[v[-1]] == c[-1]


def test_average_ranks_and_skewed_lookup(spark):
    df, x = numbers(spark)
    got = {r["value"]: r["rank"] for r in average_rank_table(df, ["x"]).collect()}
    order = np.sort(x)
    for v in (1.0, float(x.max()), float(np.median(x))):
        pos = np.flatnonzero(order == v) + 1
        assert got[v] == pytest.approx(pos.mean())
    assert with_average_ranks(df, ["x"]).count() == len(x)
    table = df.groupBy("x").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    for limit in (10, 10**6):  # hot keys by broadcast and the rest by shuffle, or all by broadcast
        assert lookup(df, table, "x", "n", limit).agg(F.sum("top")).first() == df.join(table, "x").agg(F.sum("top")).first()


def test_row_numbers_do_not_depend_on_partitions(spark):
    df, _ = numbers(spark)
    one = shuffled_row_number(df.repartition(1), ["id"], 5, by=["g"]).select("id", "shuffle_rank")
    many = shuffled_row_number(df.repartition(7), ["id"], 5, by=["g"], digits=1).select("id", "shuffle_rank")
    assert one.exceptAll(many).isEmpty()
    per = shuffled_row_number(df, ["id"], 5, by=["g"]).groupBy("g").agg(F.count_distinct("shuffle_rank").alias("d"), F.max("shuffle_rank").alias("m"), F.count("*").alias("n"))
    assert all(r["d"] == r["m"] == r["n"] for r in per.collect())


def edge(spark):
    rows = [
        (1.0, None, "k", "u1", True), (2.0, None, "k", "u2", True), (float("nan"), None, "k", "u3", False), (float("inf"), None, "k", "u4", True),
        (2.0, None, "k", "u5", True), (None, None, "k", "u6", True), (3.0, None, "k", "u7", True), (3.0, None, None, None, True),
    ]
    return spark.createDataFrame(rows, "x double, empty double, const string, uniq string, flag boolean")


def test_alerts_fire_and_stay_silent(spark):
    got = {(r["Variable"], r["Alert"]) for r in profile.alerts(edge(spark)).collect()}
    assert {("const", "Constant"), ("x", "Missing Values"), ("empty", "Missing Values"), ("x", "Infinite Values"), ("uniq", "Unique Values"), ("flag", "Imbalanced")} <= got
    assert ("uniq", "Constant") not in got and ("flag", "Unique Values") not in got and ("uniq", "Cardinality") not in got
    assert ("empty", "Constant") not in got
    many = spark.range(0, 200).select(F.col("id").cast("string").alias("c"), F.pow(F.col("id"), F.lit(4)).alias("skewed"), F.col("id").alias("flat"))
    got = {(r["Variable"], r["Alert"]) for r in profile.alerts(many).collect()}
    assert {("c", "Cardinality"), ("c", "Unique Values"), ("skewed", "Skewness"), ("flat", "Kurtosis")} <= got
    assert ("flat", "Skewness") not in got and ("flat", "Outliers") not in got


def test_empty_table_and_mad_zero(spark):
    empty = edge(spark).where("1 = 0")
    facts = {r["fact"]: r["value"] for r in profile.overview(empty).collect()}
    assert facts["Number of rows"] == 0 and facts["Number of univariate outliers"] == 0
    flat = spark.createDataFrame([(1.0,)] * 9 + [(5.0,)], "x double")
    row = profile.mad_outliers(flat).first()
    assert row["mad"] == 0 and row["n_outliers"] == 1
    assert charts.histogram(flat, "x").count() == 1  # IQR = 0


def test_normality_scores_by_formula(spark):
    # sample 0..19: skewness 0, kurtosis of the discrete uniform distribution
    df = spark.range(0, 20).select(F.col("id").cast("double").alias("x"))
    r = profile.normality(df).first()
    assert r["skewness"] == pytest.approx(0) and r["kurtosis"] == pytest.approx(-1.2 * (400 + 1) / (400 - 1))
    assert r["kurtosis_z"] < -1.7 and r["kurtosis_p"] == pytest.approx(dist.norm_two_sided(r["kurtosis_z"]))
    assert profile.normality(df.limit(4)).first()["kurtosis_z"] is None


def test_associations_edge_cases(spark):
    df = spark.createDataFrame([("a", "k", 1.0, 5.0), ("b", "k", 2.0, 5.0), ("a", "k", 3.0, 5.0), ("b", "k", 4.0, 5.0)], "c string, k string, x double, flat double")
    t = {(r["var_1"], r["var_2"]): r for r in associations.associations(df).collect()}
    assert t["c", "k"]["value"] == 0 and t["k", "x"]["value"] == 0 and t["k", "x"]["p_value"] == 1
    assert t["x", "x"]["value"] == pytest.approx(1) and t["x", "flat"]["value"] is None
    assert t["c", "x"]["value"] == pytest.approx(math.sqrt(0.2)) and t["x", "c"]["value"] == t["c", "x"]["value"]


def test_names_and_values(spark):
    assert clean_name("  Año  de la-Renta!") == "Ano_de_laRenta"
    with pytest.raises(ValueError):
        clean_names(spark.createDataFrame([(1, 2)], "`a b` int, `a  b` int"))
    df = spark.createDataFrame([("São Paulo!", True), (None, False)], "`my.city` string, b boolean")
    assert [tuple(r) for r in clean_values(df).collect()] == [("SaoPaulo", "True"), (None, "False")]
    assert roles(df).cat == ["my.city", "b"]
    assert reshape.missing_indicators(df).columns == ["my.city", "b", "Missing_in_my.city"]


def test_split_shuffles_each_row_once(spark):
    from lakelens.operators.split import train_test_split

    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "big").otherwise("small").alias("c"))  # two hot strata
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
            spark.conf.set(k, v)
        parts = train_test_split(df, "c", ["id"])
        plan = parts._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin" not in plan  # no join that brings a stratum to one task
    assert {r["c"]: (r["n"], r["t"]) for r in parts.groupBy("c").agg(F.count("*").alias("n"), F.sum(F.col("is_train").cast("int")).alias("t")).collect()} == {"big": (2000, 1600), "small": (1000, 800)}


def test_split_shuffles_rows_without_their_hash(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    df = spark.range(3000).select("id", (F.col("id") % 2).alias("c"), F.rand(1).alias("x")).localCheckpoint()
    try:
        for k, v in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
            spark.conf.set(k, v)
        ranked = shuffled_row_number(df, ["id"], 5, by=["c"])
        plan = ranked._jdf.queryExecution().executedPlan()
        dealt, stack = [], [plan]
        while stack:  # exchanges of rows, which have the column x
            node = stack.pop()
            names = [a.name() for a in (node.output().apply(i) for i in range(node.output().size()))]
            if "Exchange" in node.nodeName() and "x" in names:
                dealt.append(names)
            stack += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert [sorted(n) for n in dealt] == [["c", "id", "x"]]  # once, and neither the hash nor its prefix
    got = {(r["c"], r["id"]): r["shuffle_rank"] for r in ranked.collect()}
    for c in (0, 1):
        wanted = sorted((i for i in range(3000) if i % 2 == c), key=lambda i: hashlib.md5(f"{i}|5".encode()).hexdigest())
        assert [got[c, i] for i in wanted] == list(range(1, 1501))


@pytest.mark.parametrize("few", [True, False])
def test_written_once_is_distinct(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(reshape, "BROADCAST_ROWS", 1)
    nan, rows = float("nan"), [(i % 40, float(i % 40), f"t{i % 40}") for i in range(60)]
    rows += [(100, 0.0, "z"), (100, -0.0, "z"), (101, nan, "n"), (101, nan, "n"), (None, None, None), (None, None, None), (None, 1.0, "a"), (1, None, "a")]
    df = spark.createDataFrame(rows, "i int, x double, s string").repartition(5)
    seen = lambda d: sorted(str((r["i"], None if r["x"] is None else r["x"] + 0.0, r["s"])) for r in d.collect())
    assert seen(reshape.written_once(df)) == seen(df.distinct()) and len(seen(df.distinct())) == 45
    assert seen(reshape.written_once(df.where("i >= 20 AND i < 40"))) == seen(df.where("i >= 20 AND i < 40"))  # none twice
    assert reshape.written_once(df.where("i > 200")).count() == 0


def test_written_once_shuffles_hashes_only(spark, monkeypatch):
    def refuse(df):
        raise AssertionError("rows are compared although no hash comes twice")

    monkeypatch.setattr(reshape, "drop_duplicates", refuse)
    df = spark.range(500).select("id", F.lit("a long text").alias("s"))
    assert reshape.written_once(df).count() == 500
