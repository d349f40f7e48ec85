"""Running totals, ranks and row numbers over a global order without a single-task window.

An ordered window without a partition key runs in one task. Here the order is split into ranges first;
ranges are numbered, their totals are summed over the few range rows, and each range is then handled by
its own window partition. Values are pre-aggregated, so a value that holds a third of the rows is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelens.functions.columns import col, number
from lakelens.plans.session import BROADCAST_NUMBERS, BROADCAST_ROWS, cut, lookup

STEP = 64
MIN_RANGES, MAX_RANGES = 4, STEP * STEP
RANGE_ROWS = 100_000  # wanted rows per range
MAX_BROADCAST_GROUPS = 5_000


def _range_of(value: Column, edges: Column, ranges: int) -> Column:
    """Number of sorted edges below the value; long edge lists are searched in two steps."""
    if ranges <= STEP:
        return F.size(F.filter(edges, lambda e: e < value))
    coarse = F.size(F.filter(F.sequence(F.lit(STEP), F.size(edges), F.lit(STEP)), lambda i: F.get(edges, i - 1) < value))
    coarse = F.when(F.size(edges) >= STEP, coarse).otherwise(0)
    return coarse * STEP + F.size(F.filter(F.slice(edges, coarse * STEP + 1, F.lit(STEP)), lambda e: e < value))


def running_totals(
    counts: DataFrame,
    order: str,
    weights: list[str],
    by: list[str] | None = None,
    descending: bool = False,
    ranges: int | None = None,
    few_groups: bool = False,
) -> DataFrame:
    """Add ``<w>_cum``, the inclusive running sum of each weight in the order of ``order``.

    ``counts`` has one row per (by, order value). The range edges of the groups are broadcast only when
    there are few groups: by construction (``few_groups``, e.g. column names) or by count.
    """
    by = list(by or [])
    counts = counts.persist()
    if ranges is None:
        ranges = min(MAX_RANGES, max(MIN_RANGES, counts.count() // RANGE_ROWS))
    probs = [i / ranges for i in range(1, ranges)]
    key = [F.col(b) for b in by]
    edges = counts.groupBy(*key).agg(
        F.array_sort(F.array_distinct(F.percentile_approx(order, probs, 20_000))).alias("__edges")
    )
    spark = counts.sparkSession
    small = few_groups or not by
    if not small:
        edges = edges.persist()
        small = edges.count() <= MAX_BROADCAST_GROUPS
    if not by:
        ranged = counts.withColumn("__edges", F.array(*[F.lit(float(e)) for e in (edges.first()[0] or [])]).cast("array<double>"))
    elif small:  # a few rows: fetched once, so that later stages do not compute them again
        ranged = counts.join(F.broadcast(spark.createDataFrame(edges.collect(), edges.schema)), by)
    else:
        ranged = counts.join(edges, by)
    hint = F.broadcast if small else (lambda table: table)
    ranged = ranged.withColumn("__r", _range_of(F.col(order).cast("double"), F.col("__edges"), ranges)).drop("__edges")
    totals = ranged.groupBy(*key, "__r").agg(*[F.sum(w).alias(f"__t_{w}") for w in weights])
    direction = F.col("__r").desc() if descending else F.col("__r").asc()
    before = Window.partitionBy(*key).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    # at most `ranges` rows per group of `by`
    offsets = totals.select(
        *key, "__r", *[F.coalesce(F.sum(f"__t_{w}").over(before), F.lit(0)).alias(f"__o_{w}") for w in weights]
    )
    inner = F.col(order).desc() if descending else F.col(order).asc()
    local = Window.partitionBy(*key, "__r").orderBy(inner).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(hint(offsets), [*by, "__r"])
    for w in weights:
        out = out.withColumn(f"{w}_cum", F.col(f"__o_{w}") + F.sum(w).over(local))
    return out.drop("__r", *[f"__o_{w}" for w in weights])


def value_counts_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, value, n) of numeric columns in one shuffle of pre-aggregated distinct values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), number(df, c).alias("value")) for c in columns])
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.variable", "p.value")
        .where("value IS NOT NULL")
        .groupBy("variable", "value")
        .agg(F.count("*").alias("n"))
    )


def average_rank_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, value, n, rank): ties share the mean of their positions 1..N."""
    ranked = running_totals(value_counts_long(df, columns), "value", ["n"], by=["variable"], few_groups=True)
    return ranked.select("variable", "value", "n", (F.col("n_cum") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))


def with_average_ranks(df: DataFrame, columns: list[str], suffix: str = "__rank") -> DataFrame:
    """Attach the average rank of each (complete) numeric column to every row."""
    table = average_rank_table(df, columns).persist()
    for c in columns:
        # adding 0.0 folds -0.0 into 0.0, as grouping does
        part = table.where(F.col("variable") == c).select(
            F.col("value").alias("__k"), F.col("n").alias("__n"), F.col("rank").alias(c + suffix)
        )
        df = lookup(df.withColumn("__k", number(df, c) + F.lit(0.0)), part, "__k", "__n", BROADCAST_NUMBERS).drop("__k")
    return df


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """(value, n, ecdf) for the distinct values of a column."""
    counts = value_counts_long(df, [column]).drop("variable")
    cum = running_totals(counts, "value", ["n"])
    total = df.agg(F.count(number(df, column))).first()[0]
    return cum.select("value", "n", (F.col("n_cum") / F.lit(float(total or 1))).alias("ecdf"))


def hash_order(id_columns: list[str], seed: int | str) -> Column:
    """md5 text of the id and the seed: a shuffle order that any engine can repeat."""
    return F.md5(F.concat_ws("|", *[col(c).cast("string") for c in id_columns], F.lit(str(seed))))


def shuffled_row_number(
    df: DataFrame, id_columns: list[str], seed: int | str, by: list[str] | None = None, out: str = "shuffle_rank", digits: int = 3, total: str | None = None
) -> DataFrame:
    """Row number 1..n in hash order, optionally within strata, split over 16**digits hash prefixes; ``total`` names a
    column for the number of rows of the stratum.

    Hash prefixes are even by construction, so a stratum with a third of all rows spreads over all of
    them. The id columns must identify a row. Rows are shuffled once, and without their hash, which is made again
    behind the shuffle: the sizes of strata and prefixes are counted beforehand, and come by broadcast unless there are
    very many strata.
    """
    by = list(by or [])
    text_key = hash_order(id_columns, seed)
    keys = {"__h": F.unhex(text_key), "__b": F.substring(text_key, 1, digits)}
    keyed = df.withColumns(keys)
    sizes = keyed.groupBy(*[F.col(b).alias(f"__k_{b}") for b in by], F.col("__b").alias("__kb")).agg(F.count("*").alias("__n"))
    stratum = Window.partitionBy(*[f"__k_{b}" for b in by])  # at most 16**digits rows per stratum
    before = stratum.orderBy("__kb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumns({"__o": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__t": F.sum("__n").over(stratum)}).drop("__n").persist()
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    cond = F.col("__b") == F.col("__kb")
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"__k_{b}"))
    local = Window.partitionBy(*by, "__b").orderBy("__h", *id_columns)
    numbered = df.repartition(*by, keys["__b"]).withColumns(keys).withColumn("__l", F.row_number().over(local))
    new = {out: (F.col("__o") + F.col("__l")).cast("long")} | ({total: F.col("__t")} if total else {})
    return numbered.join(offsets, cond).withColumns(new).drop("__h", "__b", "__kb", "__o", "__t", "__l", *[f"__k_{b}" for b in by])


def numbered(rows: DataFrame, by: list[str], out: str = "number") -> DataFrame:
    """``rows`` with ``out``, their number from 0 in the order of ``by`` (any orderable columns, nulls first).

    Rows are cut into sorted ranges and written with their place; the sizes of the ranges, one number for each, are added up.
    Rows that agree in ``by`` spread over ranges by their place in the input.
    """
    rows = rows.withColumn("__salt", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*by, "__salt").sortWithinPartitions(*by, "__salt").drop("__salt")
    rows = cut(rows.withColumn("__place", F.monotonically_increasing_id())).withColumn("__range", F.shiftright("__place", 33))
    sizes = rows.groupBy("__range").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__range")) - F.col("__size")  # one row by range
    first = F.broadcast(sizes.select("__range", before.alias("__before")))
    number_ = F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1)
    return rows.join(first, "__range").withColumn(out, number_).drop("__range", "__place", "__before")
