"""Association measures between columns of any type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.functions.columns import col, is_missing, number, roles, text
from lakelens.functions.dist import chi2_sf_udf, f_sf_udf, t_two_sided_udf
from lakelens.operators.prep import fill_modes
from lakelens.operators.reshape import lower_triangle, missing_indicators
from lakelens.plans.ranking import with_average_ranks

LONG = ["var_1", "var_2", "kind", "value", "stat", "df1", "df2", "p_value"]


def _pairs(names: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i:]]


def _correlations(df: DataFrame, names: list[str], kind: str, suffix: str = "") -> DataFrame:
    """Correlation of every unordered pair in one aggregate, then (var_1, var_2, ...) rows with p."""
    pairs = _pairs(names)
    x = {c: number(df, c + suffix) for c in names}
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = x[a].isNotNull() & x[b].isNotNull()
        u, v = F.when(both, x[a]), F.when(both, x[b])
        spread = F.stddev_pop(u) * F.stddev_pop(v)  # zero for a constant column: no correlation
        value = F.when(spread > 0, F.covar_pop(u, v) / spread)
        aggs.append(F.struct(value.alias("value"), F.count(u).alias("n")).alias(f"s{i}"))
    rows = df.agg(*aggs).select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(a).alias("var_1"), F.lit(b).alias("var_2"), F.col(f"s{i}.value").alias("value"), F.col(f"s{i}.n").alias("n"))
                    for i, (a, b) in enumerate(pairs)
                ]
            )
        ).alias("p")
    ).select("p.*")
    value = F.when(F.col("value").isNotNull(), F.greatest(F.least(F.col("value"), F.lit(1.0)), F.lit(-1.0)))  # greatest / least skip NULL
    dof = (F.col("n") - 2).cast("double")
    t = F.when(F.abs("value") < 1.0, F.col("value") * F.sqrt(F.try_divide(dof, 1 - F.col("value") * F.col("value")))).otherwise(
        F.signum("value") * F.lit(float("inf"))
    )
    return (
        rows.withColumn("value", value)
        .select("var_1", "var_2", F.lit(kind).alias("kind"), "value", F.when(F.col("value").isNotNull(), t).alias("stat"), dof.alias("df1"), F.lit(None).cast("double").alias("df2"))
        .withColumn("p_value", t_two_sided_udf("stat", "df1"))
    )


def pearson(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _correlations(df, columns or roles(df).num, "pearson")


def spearman(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson on average ranks; rows must be complete in the columns."""
    names = columns or roles(df).num
    ranked = with_average_ranks(df.select([number(df, c).alias(c) for c in names]), names)
    return _correlations(ranked, names, "spearman", "__rank")


def contingency_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(var_1, var_2, n, r, k, chi2) for every unordered pair of categorical columns.

    chi2 = n (sum n_ij^2 / (n_i n_j) - 1) needs only the occupied cells, so the zero cells of a sparse
    table are never built. All pairs share one shuffle of pre-aggregated cells.
    """
    names = columns or roles(df).cat
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("var_1"), F.lit(b).alias("var_2"), text(df, a).alias("a"), text(df, b).alias("b"))
            for a, b in _pairs(names)
        ]
    )
    cells = (
        df.select(F.explode(pairs).alias("p"))
        .select("p.*")
        .where("a IS NOT NULL AND b IS NOT NULL")
        .groupBy("var_1", "var_2", "a", "b")
        .agg(F.count("*").alias("n"))
        .persist()
    )
    pair = ["var_1", "var_2"]
    rows = cells.groupBy(*pair, "a").agg(F.sum("n").alias("na"))
    cols = cells.groupBy(*pair, "b").agg(F.sum("n").alias("nb"))
    ratio = (
        cells.join(rows, [*pair, "a"])
        .join(cols, [*pair, "b"])
        .groupBy(*pair)
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") / F.col("na") * (F.col("n") / F.col("nb"))).alias("q"))
    )
    r = rows.groupBy(*pair).agg(F.count("*").alias("r"))
    k = cols.groupBy(*pair).agg(F.count("*").alias("k"))
    return (
        ratio.join(r, pair)
        .join(k, pair)
        .select(*pair, "n", "r", "k", F.greatest(F.col("n") * (F.col("q") - 1), F.lit(0.0)).alias("chi2"))
    )


def chi2_test(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(var_1, var_2, n, chi2, dof, p_value) without continuity correction."""
    s = contingency_stats(df, columns).withColumn("dof", ((F.col("r") - 1) * (F.col("k") - 1)).cast("double"))
    return s.select("var_1", "var_2", "n", "chi2", "dof", F.when(F.col("dof") == 0, 1.0).otherwise(chi2_sf_udf("chi2", "dof")).alias("p_value"))


def corrected_v(n, r, k, chi2):
    """Bias-corrected Cramer's V as a column expression."""
    m = n - 1
    phi = F.greatest(F.lit(0.0), chi2 / n - F.try_divide((k - 1) * (r - 1), m))
    rc = r - F.coalesce(F.try_divide((r - 1) * (r - 1), m), F.lit(0.0))
    kc = k - F.coalesce(F.try_divide((k - 1) * (k - 1), m), F.lit(0.0))
    small = F.least(rc - 1, kc - 1)
    return F.when(small == 0, 0.0).otherwise(F.sqrt(phi / small))


def cramers_v(df: DataFrame, columns: list[str] | None = None, corrected: bool = True) -> DataFrame:
    s = contingency_stats(df, columns)
    if corrected:
        v = corrected_v(F.col("n"), F.col("r"), F.col("k"), F.col("chi2"))
    else:
        small = F.least("r", "k") - 1
        v = F.when(small == 0, 0.0).otherwise(F.sqrt(F.col("chi2") / (F.col("n") * small)))
    dof = ((F.col("r") - 1) * (F.col("k") - 1)).cast("double")
    return (
        s.select("var_1", "var_2", F.lit("cramers_v").alias("kind"), v.alias("value"), F.col("chi2").alias("stat"), dof.alias("df1"), F.lit(None).cast("double").alias("df2"))
        .withColumn("p_value", F.when(F.col("df1") == 0, 1.0).otherwise(chi2_sf_udf("stat", "df1")))
    )


def correlation_ratio(df: DataFrame, cats: list[str] | None = None, nums: list[str] | None = None) -> DataFrame:
    """sqrt(eta^2) and one-way ANOVA F for every (categorical, numeric) pair from one shuffle.

    Values are centred on their mean first, so the between and total sums of squares do not cancel.
    A constant category gives 0 with p = 1.
    """
    rl = roles(df)
    cats, nums = cats or rl.cat, nums or rl.num
    x = {c: number(df, c) for c in nums}
    means = df.agg(*[F.coalesce(F.avg(x[c]), F.lit(0.0)).alias(f"m{j}") for j, c in enumerate(nums)]).first()
    base = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("var_1"), text(df, c).alias("g")) for c in cats])).alias("p"),
        *[(x[c] - F.lit(means[f"m{j}"])).alias(f"x{j}") for j, c in enumerate(nums)],
    ).where("p.g IS NOT NULL")
    groups = base.groupBy("p.var_1", "p.g").agg(
        *[F.struct(F.count(f"x{j}").alias("n"), F.sum(f"x{j}").alias("s"), F.sum(F.col(f"x{j}") * F.col(f"x{j}")).alias("ss")).alias(f"v{j}") for j in range(len(nums))]
    )
    long = groups.select(
        "var_1", F.explode(F.array(*[F.struct(F.lit(c).alias("var_2"), F.col(f"v{j}").alias("v")) for j, c in enumerate(nums)])).alias("q")
    ).select("var_1", "q.var_2", "q.v.*").where("n > 0")
    s = long.groupBy("var_1", "var_2").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
        (F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")).alias("ssb"),
        (F.sum("ss") - F.sum("s") * F.sum("s") / F.sum("n")).alias("sst"),
    )
    df1, df2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    one = F.col("k") < 2
    ssb = F.greatest(F.col("ssb"), F.lit(0.0))
    within = F.greatest(F.col("sst") - ssb, F.lit(0.0))
    f = F.when(one, 0.0).when(within > 0, F.try_divide(F.try_divide(ssb, df1), F.try_divide(within, df2)))
    value = F.when(one, 0.0).when(F.col("sst") > 0, F.sqrt(ssb / F.col("sst")))
    return s.select(
        "var_1", "var_2", F.lit("correlation_ratio").alias("kind"), value.alias("value"), f.alias("stat"), df1.alias("df1"), df2.alias("df2")
    ).withColumn("p_value", F.when(F.col("df1") < 1, 1.0).otherwise(f_sf_udf("stat", "df1", "df2")))


def associations(df: DataFrame, num_num: str = "spearman", columns: list[str] | None = None) -> DataFrame:
    """Long association table for every ordered pair, after filling missing values with the mode.

    Numeric pairs: Spearman or Pearson; categorical pairs: bias-corrected Cramer's V; mixed pairs: the
    correlation ratio. Each unordered pair is computed once and mirrored. Time columns take no part.
    """
    rl = roles(df, columns)
    full = fill_modes(df.select([col(c) for c in rl.num + rl.cat]), rl.num, rl.cat)
    parts = []
    if rl.num:
        parts.append((spearman if num_num == "spearman" else pearson)(full, rl.num))
    if rl.cat:
        parts.append(cramers_v(full, rl.cat))
    if rl.num and rl.cat:
        parts.append(correlation_ratio(full, rl.cat, rl.num))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.persist()
    swapped = [F.col("var_2").alias("var_1"), F.col("var_1").alias("var_2"), *LONG[2:]]
    return out.select(LONG).unionByName(out.where("var_1 <> var_2").select(swapped))


def to_matrix(long: DataFrame, order: list[str], value: str = "value") -> DataFrame:
    """Square display table with one row per variable."""
    return long.groupBy(F.col("var_1").alias("variable")).pivot("var_2", order).agg(F.first(value))


def missingness_associations(df: DataFrame, columns: list[str] | None = None, num_num: str = "spearman") -> DataFrame:
    """Associations of the missing indicators with everything else, each pair once."""
    base = df.select([col(c) for c in columns]) if columns else df
    flagged = missing_indicators(base)
    rl = roles(flagged)
    order = [c for c in flagged.columns if c in rl.num + rl.cat]
    return lower_triangle(associations(flagged, num_num), order, indicators_only=True)
