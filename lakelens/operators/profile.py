"""Table overview, per-column descriptions, outliers, normality tests and alerts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.functions.columns import col, complete_rows, is_missing, number, roles, text
from lakelens.functions.dist import norm_two_sided
from lakelens.operators.reshape import duplicate_count
from lakelens.plans.quantiles import exact_quantiles

MAD_FACTOR = 0.6745  # fixed value: scale of the median absolute deviation score


def report(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small result table from a few driver values (one row per column, metric or model)."""
    plain = [tuple(v.item() if isinstance(v, np.generic) else v for v in row) for row in rows]
    return spark.createDataFrame(plain, schema)


def missing_per_column(df: DataFrame) -> DataFrame:
    """(variable, n_missing, pct) for all columns in one pass."""
    row = df.agg(F.count("*").alias("n"), *[F.count(F.when(is_missing(df, c), 1)).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    n = row["n"]
    return report(
        df.sparkSession,
        [(c, row[f"m{i}"], 100.0 * row[f"m{i}"] / n if n else None) for i, c in enumerate(df.columns)],
        "variable string, n_missing long, pct double",
    )


def mad_outliers(df: DataFrame, threshold: float = 3.5, columns: list[str] | None = None) -> DataFrame:
    """(variable, n, median, mad, n_outliers) over rows complete in all numeric columns.

    Score = 0.6745 |x - median| / MAD; with MAD = 0 every value off the median is an outlier.
    """
    names = columns or roles(df).num
    rows = complete_rows(df, names)
    med = {c: q[0] for c, q in exact_quantiles(rows, names, [0.5]).items()}
    known = [c for c in names if med[c] is not None]
    dev = rows.select([F.abs(number(rows, c) - F.lit(med[c])).alias(c) for c in known])
    mad = {c: q[0] for c, q in exact_quantiles(dev, known, [0.5]).items()}
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(known):
        d = col(c)
        out = (d > 0) if mad[c] == 0 else (F.lit(MAD_FACTOR) * d / F.lit(mad[c]) > threshold)
        aggs.append(F.count(F.when(out, 1)).alias(f"o{i}"))
    row = dev.agg(*aggs).first() if known else None
    found = {c: row[f"o{i}"] for i, c in enumerate(known)}
    return report(
        df.sparkSession,
        [(c, row["n"] if row else 0, med[c], mad.get(c), found.get(c, 0)) for c in names],
        "variable string, n long, median double, mad double, n_outliers long",
    )


def overview(df: DataFrame, threshold: float = 3.5) -> DataFrame:
    """Twelve facts about a table as (position, fact, value, text)."""
    rl = roles(df)
    width = len(df.columns)
    row = df.agg(F.count("*").alias("n"), *[F.count(F.when(is_missing(df, c), 1)).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    n, missing = row["n"], sum(row[f"m{i}"] for i in range(width))
    dup = duplicate_count(df).first()["n_duplicates"]
    out = mad_outliers(df, threshold).agg(F.sum("n_outliers")).first()[0] if rl.num else 0
    cells = n * width

    def pct(v, total):
        return 100.0 * v / total if total else math.nan

    facts = [
        ("Number of observations", cells - missing, False),
        ("Number of rows", n, False),
        ("Number of variables", width, False),
        ("Number of categorical variables", len(rl.cat), False),
        ("Number of numerical variables", len(rl.num), False),
        ("Number of date or datetime variables", len(rl.time), False),
        ("Number of missing cells", missing, False),
        ("Missing cells (%)", pct(missing, cells), True),
        ("Number of duplicated rows", dup, False),
        ("Duplicated rows (%)", pct(dup, n), True),
        ("Number of univariate outliers", out, False),
        ("Univariate outliers (%)", pct(out, cells), True),
    ]
    return report(
        df.sparkSession,
        [(i + 1, f, float(v), f"{v:.1f}%" if is_pct else str(v)) for i, (f, v, is_pct) in enumerate(facts)],
        "position int, fact string, value double, text string",
    )


def value_counts(df: DataFrame, columns: list[str] | None = None, keep_missing: bool = False) -> DataFrame:
    """(variable, value, n) of the categorical columns in one shuffle of pre-aggregated values."""
    names = columns or roles(df).cat
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), text(df, c).alias("value")) for c in names])
    long = df.select(F.explode(pairs).alias("p")).select("p.variable", "p.value")
    if not keep_missing:
        long = long.where("value IS NOT NULL")
    return long.groupBy("variable", "value").agg(F.count("*").alias("n"))


def category_facts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(variable, n_rows, n_missing, n_distinct, n_unique, top, freq, balance) per categorical column.

    ``n_distinct`` counts missing as one value, ``n_unique`` does not; ``top`` is the most frequent value
    (ties: the smallest); ``balance`` = -sum p ln p / ln k over values incl. missing.
    """
    counts = value_counts(df, columns, keep_missing=True)
    n = F.sum("n")
    # sum of -p ln p rewritten on counts, so that one aggregate is enough
    entropy = F.ln(n) - F.sum(F.col("n") * F.ln("n")) / n
    return counts.groupBy("variable").agg(
        n.alias("n_rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_missing"),
        F.count("*").alias("n_distinct"),
        F.count("value").alias("n_unique"),
        F.min_by(F.col("value"), F.when(F.col("value").isNotNull(), F.struct(-F.col("n"), F.col("value")))).alias("top"),
        F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("freq"),
        F.when(F.count("*") > 1, entropy / F.ln(F.count("*"))).alias("balance"),
    )


def describe_categorical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return category_facts(df, columns).select(
        "variable", (F.col("n_rows") - F.col("n_missing")).alias("count"), F.col("n_unique").alias("unique"), "top", "freq"
    )


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(variable, count, mean, std, min, q25, q50, q75, max), quartiles exact."""
    names = columns or roles(df).num
    aggs = []
    for i, c in enumerate(names):
        x = number(df, c)
        aggs.append(F.struct(F.count(x), F.avg(x), F.stddev_samp(x), F.min(x), F.max(x)).alias(f"s{i}"))
    row = df.agg(*aggs).first()
    q = exact_quantiles(df, names, [0.25, 0.5, 0.75])
    rows = []
    for i, c in enumerate(names):
        n, mean, sd, lo, hi = row[f"s{i}"]
        rows.append((c, n, mean, sd, lo, *q[c], hi))
    return report(
        df.sparkSession,
        rows,
        "variable string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double",
    )


def distinct_counts(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """(variable, n_unique, n_distinct): without and with missing as a value."""
    names = columns or df.columns
    if approximate:
        row = df.agg(
            *[F.struct(F.approx_count_distinct(col(c), 0.02), F.max(is_missing(df, c).cast("int"))).alias(f"d{i}") for i, c in enumerate(names)]
        ).first()
        return report(
            df.sparkSession,
            [(c, row[f"d{i}"][0], row[f"d{i}"][0] + (row[f"d{i}"][1] or 0)) for i, c in enumerate(names)],
            "variable string, n_unique long, n_distinct long",
        )
    pairs = F.array(
        *[F.struct(F.lit(c).alias("variable"), F.when(~is_missing(df, c), col(c).cast("string")).alias("value")) for c in names]
    )
    values = df.select(F.explode(pairs).alias("p")).select("p.*").groupBy("variable", "value").agg(F.lit(1).alias("one"))
    return values.groupBy("variable").agg(F.count("value").alias("n_unique"), F.count("*").alias("n_distinct"))


def skew_z(skew: float, n: float) -> float | None:
    """D'Agostino's normal score of a sample skewness (n >= 8)."""
    if skew is None or math.isnan(skew) or n < 8:
        return None
    y = skew * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta - 1)) - 1
    y = y or 1.0
    return math.asinh(y / math.sqrt(2.0 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))


def kurtosis_z(excess: float, n: float) -> float | None:
    """Anscombe-Glynn normal score of a sample excess kurtosis (n >= 5)."""
    if excess is None or math.isnan(excess) or n < 5:
        return None
    mean = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (excess + 3.0 - mean) / math.sqrt(var)
    b1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / b1 * (2.0 / b1 + math.sqrt(1 + 4.0 / b1**2))
    base = 1 + x * math.sqrt(2.0 / (a - 4))
    if base == 0:
        return None
    third = math.copysign(((1 - 2.0 / a) / abs(base)) ** (1 / 3), base)
    return (1 - 2.0 / (9 * a) - third) / math.sqrt(2.0 / (9 * a))


def normality(df: DataFrame, columns: list[str] | None = None, strict: bool = False) -> DataFrame:
    """(variable, n, skewness, skew_z, skew_p, kurtosis, kurtosis_z, kurtosis_p) from one aggregate.

    Missing values are skipped; ``strict=True`` gives no result for a column that has any.
    """
    names = columns or roles(df).num
    aggs = []
    for i, c in enumerate(names):
        x = number(df, c)
        aggs.append(F.struct(F.count(x), F.skewness(x), F.kurtosis(x), F.count(F.when(is_missing(df, c), 1))).alias(f"s{i}"))
    row = df.agg(*aggs).first()
    rows = []
    for i, c in enumerate(names):
        n, sk, ku, missing = row[f"s{i}"]
        skip = strict and missing > 0
        zs, zk = (None, None) if skip else (skew_z(sk, n), kurtosis_z(ku, n))
        rows.append((c, n, sk, zs, None if zs is None else norm_two_sided(zs), ku, zk, None if zk is None else norm_two_sided(zk)))
    return report(
        df.sparkSession,
        rows,
        "variable string, n long, skewness double, skew_z double, skew_p double, kurtosis double, kurtosis_z double, kurtosis_p double",
    )


def constant_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(variable, value): columns with exactly one non-missing value; min = max needs no distinct count."""
    names = columns or [c for c in df.columns if c not in roles(df).other]
    aggs = []
    for i, c in enumerate(names):
        v = F.when(~is_missing(df, c), col(c))
        aggs.append(F.struct((F.min(v) == F.max(v)).alias("one"), F.min(v).cast("string").alias("v")).alias(f"s{i}"))
    row = df.agg(*aggs).first()
    return report(
        df.sparkSession, [(c, row[f"s{i}"]["v"]) for i, c in enumerate(names) if row[f"s{i}"]["one"]], "variable string, value string"
    )


def infinite_counts(df: DataFrame) -> DataFrame:
    """(variable, n_infinite, pct) of the numeric columns."""
    names = roles(df).num
    row = df.agg(F.count("*").alias("n"), *[F.count(F.when(F.abs(number(df, c)) == float("inf"), 1)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    return report(
        df.sparkSession,
        [(c, row[f"m{i}"], 100.0 * row[f"m{i}"] / row["n"] if row["n"] else None) for i, c in enumerate(names)],
        "variable string, n_infinite long, pct double",
    )


def column_facts(df: DataFrame) -> dict[str, dict]:
    """Missing, constant, infinite and moment facts of all columns from ONE aggregate."""
    rl = roles(df)
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(df.columns):
        gone = is_missing(df, c)
        parts = [F.count(F.when(gone, 1)).alias("missing")]
        if c not in rl.other:
            v = F.when(~gone, col(c))
            parts += [F.min(v).cast("string").alias("low"), (F.min(v) == F.max(v)).alias("constant")]
        if c in rl.num:
            x = number(df, c)
            parts += [F.count(F.when(F.abs(x) == float("inf"), 1)).alias("infinite"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurtosis")]
        aggs.append(F.struct(*parts).alias(f"s{i}"))
    row = df.agg(*aggs).first()
    return {c: {"n": row["n"], **row[f"s{i}"].asDict()} for i, c in enumerate(df.columns)}


def alerts(
    df: DataFrame,
    associations: DataFrame | None = None,
    cardinality: int = 50,
    correlation: float = 0.5,
    kurtosis_alpha: float = 0.05,
    skew_alpha: float = 0.05,
    balance: float = 0.95,
    outlier_threshold: float = 3.5,
    strict: bool = False,
) -> DataFrame:
    """(Variable, Alert, Detail, stat, p_value, n, pct), sorted by alert.

    ``associations`` is the long table of :func:`lakelens.operators.associations.associations`.
    """
    rl = roles(df)
    rows: list[tuple] = []

    def add(variable, alert, detail, stat=None, p=None, n=None, pct=None):
        rows.append((variable, alert, detail, stat, p, n, pct))

    for c, f in column_facts(df).items():
        present = f["n"] - f["missing"]
        if f.get("constant"):
            add(c, "Constant", f"Column only contains one value: {f['low']}")
        if f["missing"]:
            pct = 100.0 * f["missing"] / f["n"]
            add(c, "Missing Values", f"Column has {f['missing']} missing values ({pct:.1f}%)", None, None, f["missing"], pct)
        if c in rl.num and not (strict and f["missing"]):
            for name, z, alpha, lead in (
                ("Kurtosis", kurtosis_z(f["kurtosis"], present), kurtosis_alpha, "Not mesokurtic"),
                ("Skewness", skew_z(f["skew"], present), skew_alpha, "Highly skewed"),
            ):
                p = None if z is None else norm_two_sided(z)
                if p is not None and p < alpha:
                    add(c, name, f"{lead} (statistic={z:.2f}, p={p:.2f})", z, p)
        if f.get("infinite"):
            pct = 100.0 * f["infinite"] / f["n"]
            add(c, "Infinite Values", f"Column has {f['infinite']} infinite values ({pct:.1f}%)", None, None, f["infinite"], pct)
    if rl.cat:
        for v in category_facts(df).collect():
            if v["n_distinct"] > cardinality:
                add(v["variable"], "Cardinality", f"Column has {v['n_distinct']} distinct values", None, None, v["n_distinct"])
            if v["balance"] is not None and v["balance"] < balance:
                add(v["variable"], "Imbalanced", f"Highly imbalanced (shannon entropy={v['balance']:.2f})", v["balance"])
            if v["n_distinct"] == v["n_rows"]:
                add(v["variable"], "Unique Values", "All values of the column are unique", None, None, v["n_distinct"])
    if rl.num:
        for v in mad_outliers(df, outlier_threshold).where("n_outliers > 0").collect():
            add(
                v["variable"],
                "Outliers",
                f"Column has {v['n_outliers']} observations that are more than {outlier_threshold:.1f} Median Absolute Deviations (MAD) away from the median",
                None,
                None,
                v["n_outliers"],
            )
    for c in rl.time:
        add(c, "Date", "Column contains Date or Datetime records")
    out = report(
        df.sparkSession, rows, "Variable string, Alert string, Detail string, stat double, p_value double, n long, pct double"
    )
    if associations is not None:
        out = out.unionByName(correlation_alerts(associations, correlation), allowMissingColumns=True)
    return out.orderBy("Alert", "Variable", "Detail")


def correlation_alerts(associations: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per ordered pair whose association exceeds the threshold in absolute value."""
    return associations.where((F.col("var_1") != F.col("var_2")) & (F.abs("value") > threshold)).select(
        F.col("var_1").alias("Variable"),
        F.lit("High Correlation").alias("Alert"),
        F.concat(F.lit("Highly correlated with "), F.col("var_2"), F.lit(" "), F.format_string("%.2f", F.col("value"))).alias("Detail"),
        F.col("value").alias("stat"),
        F.col("p_value"),
    )


def variable_alerts(alert_table: DataFrame, variable: str) -> DataFrame:
    return alert_table.where(F.col("Variable") == variable)


def suggest_tables(df: DataFrame, column: str) -> list[str]:
    """Which chart tables suit a column: category charts, distribution charts, or both."""
    few = df.agg(F.count_distinct(col(column))).first()[0]
    if column in roles(df).num:
        base = ["histogram", "kde", "qq", "box"]
        return base + ["bar", "donut", "pie"] if few < 5 else base
    base = ["bar", "donut", "pie"]
    return base + ["polar", "radar", "treemap"] if few > 3 else base
