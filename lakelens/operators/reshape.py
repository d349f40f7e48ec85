"""Projections, filters, reshaping and de-duplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelens.functions.columns import col, is_missing, number, roles, text
from lakelens.plans.quantiles import exact_quantiles
from lakelens.plans.session import BROADCAST_ROWS, cut, forget


def drop_time_columns(df: DataFrame) -> DataFrame:
    return df.drop(*roles(df).time)


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(~is_missing(df, target))


def identifier_columns(df: DataFrame, near: float = 0.95) -> list[str]:
    """Categorical columns whose distinct values (missing is one value) are as many as the rows.

    A sketch finds the candidates; only those pay for an exact distinct count.
    """
    cats = roles(df).cat
    if not cats:
        return []
    row = df.agg(F.count("*").alias("n"), *[F.approx_count_distinct(col(c), 0.02).alias(f"d{i}") for i, c in enumerate(cats)]).first()
    near_n = [c for i, c in enumerate(cats) if row[f"d{i}"] + 1 >= near * row["n"] * 0.95]
    found = []
    for c in near_n:
        exact = df.agg((F.count_distinct(col(c)) + F.max(is_missing(df, c).cast("int"))).alias("d")).first()["d"]
        if exact == row["n"]:
            found.append(c)
    return found


def drop_identifier_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    names = identifier_columns(df)
    return df.drop(*names), names


def missing_indicators(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add Missing_in_<c> in {'missing', 'present'} for each column that has missing values."""
    columns = columns or df.columns
    row = df.agg(*[F.max(is_missing(df, c).cast("int")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    hit = [c for i, c in enumerate(columns) if row[f"m{i}"] == 1]
    return df.withColumns({f"Missing_in_{c}": F.when(is_missing(df, c), "missing").otherwise("present") for c in hit})


def threshold_label(score: Column, threshold: float) -> Column:
    return F.when(score >= threshold, True).otherwise(False)


def cluster_text(label: Column) -> Column:
    return F.concat(F.lit("Cluster "), label.cast("string"))


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text that does not parse becomes NULL; only the named columns change."""
    return df.withColumns({c: col(c).cast("string").try_cast("double") for c in columns})


def high_low(df: DataFrame, columns: list[str]) -> DataFrame:
    """'low' if x <= mean(x) else 'high' for each column; the means are one small aggregate."""
    means = df.agg(*[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return df.withColumns(
        {
            f"{c}_level": F.when(number(df, c) <= means[f"m{i}"], "low").when(number(df, c) > means[f"m{i}"], "high")
            for i, c in enumerate(columns)
        }
    )


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    q = exact_quantiles(df, [column], [i / bins for i in range(bins + 1)])[column]
    return sorted({v for v in q if v is not None})


def quantile_bin(df: DataFrame, column: str, bins: int, out: str = "bin") -> DataFrame:
    """Equal-frequency bins 0..: right-closed, lowest value included, equal edges merged."""
    edges = quantile_edges(df, column, bins)
    inner = edges[1:-1] if len(edges) > 2 else []
    x = number(df, column)
    code = reduce(lambda a, e: a + (x > e).cast("int"), inner, F.lit(0))
    return df.withColumn(out, F.when(x.isNotNull(), code))


def add_run_keys(df: DataFrame, run: int, folds: int) -> DataFrame:
    """Tag a result frame with repetition and fold of its 1-based run number."""
    rep = (run - 1) // folds + 1
    return df.withColumns({"rep": F.lit(rep), "fold": F.lit(run - (rep - 1) * folds)})


def lower_triangle(long: DataFrame, order: list[str], indicators_only: bool = False) -> DataFrame:
    """Keep each unordered pair once: position(var_1) > position(var_2)."""
    pos = F.create_map(*[x for i, c in enumerate(order) for x in (F.lit(c), F.lit(i))])
    out = long.where(pos[F.col("var_1")] > pos[F.col("var_2")])
    return out.where(F.col("var_1").startswith("Missing_in_")) if indicators_only else out


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def written_once(df: DataFrame) -> DataFrame:
    """``drop_duplicates``, written. Equal rows have equal hashes, so only rows whose hash comes twice are compared.

    Hashes alone are shuffled to find these. Where very many hashes come twice, all rows are compared.
    """
    kinds = [f.dataType.simpleString() for f in df.schema.fields]
    if any(k in t for t in kinds for k in ("map<", "variant", " collate ")):  # no hash, or one that tells equal values apart
        return cut(drop_duplicates(df))
    rows = cut(df)
    h = F.xxhash64(*[col(c) for c in rows.columns])
    twice = cut(rows.groupBy(h.alias("__twice")).agg(F.count("*").alias("__n")).where("__n > 1").select("__twice"))
    n = twice.count()
    if n == 0:
        forget(twice)
        return rows
    if n <= BROADCAST_ROWS:
        hit, table = h == F.col("__twice"), F.broadcast(twice)
        out = cut(rows.join(table, hit, "left_anti").unionByName(drop_duplicates(rows.join(table, hit, "left_semi"))))
    else:
        out = cut(drop_duplicates(rows))
    forget(rows, twice)
    return out


def duplicate_count(df: DataFrame) -> DataFrame:
    """(n_rows, n_duplicates, pct): rows beyond the first of their equals."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias("__n"))
    return groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_duplicates"),
    ).withColumn("pct", F.try_divide(100.0 * F.col("n_duplicates"), F.col("n_rows")))


def stack_results(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def melt(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot([col(c) for c in ids], [number(df, c).alias(c) for c in values], "variable", "value")


def cross_table(df: DataFrame, a: str, b: str, values: list[str] | None = None) -> DataFrame:
    """Counts per (a, b) as a wide, zero-filled display table."""
    ok = df.where(~is_missing(df, a) & ~is_missing(df, b))
    return ok.groupBy(col(a)).pivot(b, values).agg(F.count(F.lit(1))).na.fill(0)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) without missing values: the long form used by all statistics."""
    ok = df.where(~is_missing(df, a) & ~is_missing(df, b))
    return ok.groupBy(text(df, a).alias("a"), text(df, b).alias("b")).agg(F.count("*").alias("n"))


def transpose_row(row: DataFrame) -> DataFrame:
    """A one-row frame as (fact, value)."""
    return row.unpivot([], [col(c).cast("double").alias(c) for c in row.columns], "fact", "value")
