"""The tables behind the usual charts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelens.functions.columns import col, complete_rows, is_missing, number, text
from lakelens.functions.dist import norm_ppf_udf
from lakelens.operators.profile import report
from lakelens.operators.reshape import contingency, missing_indicators
from lakelens.plans.quantiles import exact_quantiles, exact_quantiles_by
from lakelens.plans.ranking import running_totals, value_counts_long
from lakelens.plans.session import lookup


def category_chart(df: DataFrame, category: str, value: str | None = None) -> DataFrame:
    """(category, value, share): counts, or means of a numeric column, per category."""
    ok = df.where(~is_missing(df, category))
    agg = F.count("*").cast("double") if value is None else F.avg(number(df, value))
    per = ok.groupBy(text(df, category).alias("category")).agg(agg.alias("value"))
    total = per.agg(F.sum("value")).first()[0]
    return per.withColumn("share", F.col("value") / F.lit(total))


def bin_width(df: DataFrame, column: str) -> tuple[float, float, int]:
    """Freedman-Diaconis width 2 IQR / n^(1/3) of the whole column, its minimum and its size."""
    x = number(df, column)
    lo, n = df.agg(F.min(x), F.count(x)).first()
    q1, q3 = exact_quantiles(df, [column], [0.25, 0.75])[column]
    return (2 * (q3 - q1) / n ** (1 / 3) if n else 0.0), lo, n


def histogram(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """(group, bin, left, right, n, density); IQR = 0 gives one bin."""
    width, lo, _ = bin_width(df, column)
    x = number(df, column)
    g = text(df, group) if group else F.lit("Density")
    b = F.floor((x - F.lit(lo)) / F.lit(width)).cast("long") if width > 0 else F.lit(0).cast("long")
    ok = df.where(x.isNotNull() & g.isNotNull())
    counts = ok.groupBy(g.alias("group"), b.alias("bin")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("group").agg(F.sum("n").alias("total"))
    step = F.lit(width if width > 0 else 1.0)
    return counts.join(F.broadcast(totals), "group").select(
        "group", "bin", (F.lit(lo) + F.col("bin") * step).alias("left"), (F.lit(lo) + (F.col("bin") + 1) * step).alias("right"), "n",
        (F.col("n") / (F.col("total") * step)).alias("density"),
    )


KDE_CELLS = 50  # cells by bandwidth


def density_curve(df: DataFrame, column: str, group: str | None = None, points: int = 500) -> DataFrame:
    """Gaussian kernel density with Scott bandwidth n^(-1/5) sd: (group, i, x, density).

    Values are pooled into cells of 1/50 bandwidth, each represented by its mean, at every size: the work is
    points x cells instead of points x rows. A cell's mean has no first-order error, so the curve is off
    by at most (1/50)^2 / 8, 0.005 %, of the peak of the kernel.
    """
    x = number(df, column)
    g = text(df, group) if group else F.lit("Density")
    base = df.select(g.alias("group"), x.alias("x")).where("x IS NOT NULL AND group IS NOT NULL")
    st = base.groupBy("group").agg(
        F.count("*").alias("total"), F.stddev_samp("x").alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    st = st.withColumn("h", F.pow(F.col("total").cast("double"), F.lit(-0.2)) * F.col("sd")).where("h > 0")
    joined = lookup(base, st.withColumn("weight", F.col("total")), "group", "weight")
    key = F.floor((F.col("x") - F.col("lo")) / (F.col("h") / KDE_CELLS)).cast("double")
    cells = joined.groupBy("group", key.alias("k")).agg(
        F.count("*").alias("n"), F.avg("x").alias("m"), *[F.first(c).alias(c) for c in ("total", "h", "lo", "hi")]
    )
    at = cells.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "at", F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / points
    )
    u = (F.col("at") - F.col("m")) / F.col("h")
    return (
        at.groupBy("group", "i")
        .agg(F.first("at").alias("x"), (F.sum(F.col("n") * F.exp(-0.5 * u * u)) / (F.first("total") * F.first("h") * math.sqrt(2 * math.pi))).alias("density"))
    )


def qq_points(df: DataFrame, column: str) -> DataFrame:
    """(value, n, first, last, z_first, z_last, line): sample quantiles against normal ones i/(n+1).

    A tied value stands for positions first..last and is kept as one row; ``line`` = mean + sd z(first).
    """
    x = number(df, column)
    n, mean, sd = df.agg(F.count(x), F.avg(x), F.stddev_pop(x)).first()
    cum = running_totals(value_counts_long(df, [column]).drop("variable"), "value", ["n"])
    pos = cum.select("value", "n", (F.col("n_cum") - F.col("n") + 1).alias("first"), F.col("n_cum").alias("last"))
    z = pos.withColumn("z_first", norm_ppf_udf(F.col("first") / (n + 1))).withColumn("z_last", norm_ppf_udf(F.col("last") / (n + 1)))
    return z.withColumn("line", F.lit(mean) + F.lit(sd) * F.col("z_first"))


def box_summary(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """(group, n, min, q1, median, q3, max, low_whisker, high_whisker, n_outside)."""
    g = text(df, group) if group else F.lit("all")
    base = df.select(g.alias("group"), number(df, column).alias("x")).where("x IS NOT NULL AND group IS NOT NULL")
    q = exact_quantiles_by(base, ["group"], "x", [0.25, 0.5, 0.75]).select("group", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    inside = F.col("x").between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return (
        base.join(q, "group")
        .groupBy("group", "q1", "median", "q3")
        .agg(
            F.count("*").alias("n"),
            F.min("x").alias("min"),
            F.max("x").alias("max"),
            F.min(F.when(inside, F.col("x"))).alias("low_whisker"),
            F.max(F.when(inside, F.col("x"))).alias("high_whisker"),
            F.count(F.when(~inside, 1)).alias("n_outside"),
        )
    )


def two_way_counts(df: DataFrame, target: str, feature: str) -> DataFrame:
    """(target, feature, n, pct): pct within the target value."""
    cells = contingency(df, target, feature).persist()
    totals = cells.groupBy("a").agg(F.sum("n").alias("t"))
    return cells.join(totals, "a").select(F.col("a").alias("target"), F.col("b").alias("feature"), "n", (100 * F.col("n") / F.col("t")).alias("pct"))


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    a, b = number(df, y), number(df, x)
    return df.agg(F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2"), F.regr_count(a, b).alias("n"))


def lowess_trend(df: DataFrame, x: str, y: str, frac: float = 0.5, grid: int = 200, cells: int = 2000, rounds: int = 3) -> DataFrame:
    """(x, y_smooth) at ``grid`` points: tricube-weighted local lines with bisquare reweighting.

    Rows are pooled into at most ``cells`` equal-width cells of x (count, mean x, mean y) on the executors;
    only that fixed-size table reaches the driver.
    """
    a, b = number(df, x), number(df, y)
    ok = df.where(a.isNotNull() & b.isNotNull())
    lo, hi = ok.agg(F.min(a), F.max(a)).first()
    cell = F.least(F.floor((a - F.lit(lo)) / F.lit((hi - lo) or 1.0) * cells), F.lit(cells - 1))
    rows = ok.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.avg(a).alias("x"), F.avg(b).alias("y")).orderBy("x").collect()
    n = np.array([v["n"] for v in rows], float)
    cx, cy = np.array([v["x"] for v in rows]), np.array([v["y"] for v in rows])
    need, robust = frac * n.sum(), np.ones(len(n))

    def smooth(at):
        d = np.abs(cx - at)
        order = np.argsort(d)
        h = d[order][min(np.searchsorted(np.cumsum(n[order]), need), len(n) - 1)] or 1e-12
        w = n * robust * np.clip(1 - (d / h) ** 3, 0, None) ** 3
        if w.sum() == 0:
            w = n * (d == d.min())
        mx, my = np.average(cx, weights=w), np.average(cy, weights=w)
        sxx = np.sum(w * (cx - mx) ** 2)
        return my + (np.sum(w * (cx - mx) * (cy - my)) / sxx * (at - mx) if sxx > 0 else 0.0)

    for _ in range(rounds):
        res = np.abs(cy - np.array([smooth(v) for v in cx]))
        order = np.argsort(res)
        mad = res[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)] or 1e-12
        robust = np.clip(1 - (res / (6 * mad)) ** 2, 0, None) ** 2
    return report(df.sparkSession, [(float(v), float(smooth(v))) for v in np.linspace(lo, hi, grid)], "x double, y_smooth double")


def group_means(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, variable, mean, pct): pct = share of the group within the variable's means."""
    ok = df.where(~is_missing(df, group))
    per = ok.groupBy(text(df, group).alias("group")).agg(*[F.avg(number(df, c)).alias(c) for c in columns])
    long = per.unpivot(["group"], [col(c) for c in columns], "variable", "mean")
    totals = long.groupBy("variable").agg(F.sum("mean").alias("t"))
    return long.join(totals, "variable").select("group", "variable", "mean", F.try_divide(100 * F.col("mean"), F.col("t")).alias("pct"))


def overall_means(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.avg(number(df, c)).alias(c) for c in columns]).unpivot([], [col(c) for c in columns], "variable", "mean")


def bubble_table(df: DataFrame, x: str, y: str, size: str, color: str, label: str) -> DataFrame:
    """Complete rows of the five chosen columns (list-wise deletion over all columns of the table)."""
    return complete_rows(df, df.columns).select(
        number(df, x).alias("x"), number(df, y).alias("y"), number(df, size).alias("size"), text(df, color).alias("color"), text(df, label).alias("label")
    )


def metric_lines(scores: DataFrame, metrics: list[str], scaled: tuple[str, ...] = ("Calinski-Harabasz", "Davies-Bouldin")) -> DataFrame:
    """(model, n_clusters, metric, scaled_score): means per (model, k); unbounded metrics min-max scaled per model."""
    per = scores.groupBy("model", "n_clusters").agg(*[F.avg(col(m)).alias(m) for m in metrics])
    long = per.unpivot(["model", "n_clusters"], [col(m) for m in metrics], "metric", "score")
    w = Window.partitionBy("model", "metric")  # one row per k
    span = F.max("score").over(w) - F.min("score").over(w)
    value = F.when(F.col("metric").isin(*scaled), F.when(span > 0, (F.col("score") - F.min("score").over(w)) / span).otherwise(0.0)).otherwise(F.col("score"))
    return long.select("model", "n_clusters", "metric", value.alias("scaled_score"))


def missingness_counts(df: DataFrame, missing_in: str, other: str) -> DataFrame:
    """Counts of missing / present in one column against the values of another."""
    if missing_in == other:
        raise ValueError("a column is not compared with its own missingness")
    flagged = missing_indicators(df, [missing_in])
    return two_way_counts(flagged, f"Missing_in_{missing_in}", other)


def missingness_means(df: DataFrame, missing_in: str, columns: list[str]) -> DataFrame:
    flagged = missing_indicators(df, [missing_in])
    return group_means(flagged, f"Missing_in_{missing_in}", [c for c in columns if c != missing_in])


def score_distribution(df: DataFrame, score: str = "anomaly_score") -> dict[str, DataFrame]:
    """Box, ECDF and percent histogram of a score."""
    from lakelens.plans.ranking import ecdf

    h = histogram(df, score)
    n = df.count()
    return {"box": box_summary(df, score), "ecdf": ecdf(df, score), "histogram": h.withColumn("pct", 100 * F.col("n") / F.lit(n))}
