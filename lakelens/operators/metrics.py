"""Regression and classification scores as column aggregates; corrected t-test between models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.functions.columns import col
from lakelens.functions.dist import t_two_sided_udf

REGRESSION = ("MAE", "MSE", "RMSE", "RMSLE", "R2", "MAPE")
CLASSIFICATION = ("Accuracy", "AUC", "Recall", "Precision", "F1", "Kappa", "MCC")


def regression_scores(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """All regression scores from one aggregate (optionally per group, e.g. fold)."""
    t, q = col(y).cast("double"), col(p).cast("double")
    sq = (t - q) * (t - q)
    aggs = [
        F.avg(F.abs(t - q)).alias("MAE"),
        F.avg(sq).alias("MSE"),
        F.sqrt(F.avg(sq)).alias("RMSE"),
        F.when(F.min(F.least(t, q)) > -1, F.sqrt(F.avg(F.pow(F.log1p(t) - F.log1p(q), F.lit(2.0))))).alias("RMSLE"),
        (1 - F.try_divide(F.avg(sq), F.var_pop(t))).alias("R2"),
        F.avg(F.when(t != 0, F.abs(t - q) / t)).alias("MAPE"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def confusion(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """Occupied cells (by..., true, pred, n)."""
    return df.groupBy(*(by or []), col(y).alias("true"), col(p).alias("pred")).agg(F.count("*").alias("n"))


def per_class(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., class, tp, n_true, n_pred) over the union of true and predicted classes."""
    by = list(by or [])
    tp = F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("true").alias("class"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), tp.cast("long").alias("tp")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp")),
    )
    return (
        cells.select(*by, F.explode(sides).alias("s"))
        .select(*by, "s.*")
        .groupBy(*by, "class")
        .agg(F.sum("tp").alias("tp"), F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"))
    )


def class_report(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """(class, precision, recall, f1, support); zero where undefined."""
    c = per_class(confusion(df, y, p, by), by)
    return c.select(*(by or []), "class", _precision().alias("precision"), _recall().alias("recall"), _f1().alias("f1"), F.col("n_true").alias("support"))


def _precision():
    return F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)


def _recall():
    return F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(0.0)


def _f1():
    return 2 * F.col("tp") / (F.col("n_true") + F.col("n_pred"))


def classification_scores(df: DataFrame, y: str, p: str, average: str = "macro", by: list[str] | None = None) -> DataFrame:
    """All classification scores from one pass over the rows (then only class counts are left).

    AUC uses the hard labels: the mean over true classes of (TPR + TNR) / 2.
    """
    by = list(by or [])
    c = per_class(confusion(df, y, p, by), by)
    t, q, tp = F.col("n_true").cast("double"), F.col("n_pred").cast("double"), F.col("tp").cast("double")
    n = F.sum(t)
    c = c.withColumns({"__pr": _precision(), "__re": _recall(), "__f1": _f1()})

    def averaged(name):
        if average == "macro":
            return F.avg(name)
        if average == "weighted":
            return F.sum(F.col(name) * t) / n
        return F.sum(tp) / n  # micro

    totals = c.groupBy(*by) if by else c.groupBy()
    sums = totals.agg(
        n.alias("s"),
        F.sum(tp).alias("c"),
        F.sum(t * q).alias("tq"),
        F.sum(t * t).alias("tt"),
        F.sum(q * q).alias("qq"),
        averaged("__re").alias("Recall"),
        averaged("__pr").alias("Precision"),
        averaged("__f1").alias("F1"),
        # sum over true classes of TPR and, split in two parts, of FPR = (q - tp) / (s - t)
        F.count(F.when(t > 0, 1)).alias("k"),
        F.sum(F.when(t > 0, tp / t)).alias("tpr"),
        F.collect_list(F.when(t > 0, F.struct((q - tp).alias("fp"), t.alias("t")))).alias("__fp"),
    )
    fpr = F.aggregate("__fp", F.lit(0.0), lambda acc, e: acc + F.coalesce(F.try_divide(e["fp"], F.col("s") - e["t"]), F.lit(0.0)))
    s = F.col("s")
    po, pe = F.col("c") / s, F.col("tq") / (s * s)
    mcc_den = F.sqrt((s * s - F.col("qq")) * (s * s - F.col("tt")))
    return sums.select(
        *by,
        po.alias("Accuracy"),
        F.when(F.col("k") > 1, (F.col("tpr") + F.col("k") - fpr) / (2 * F.col("k"))).alias("AUC"),
        "Recall",
        "Precision",
        "F1",
        F.when(pe < 1, (po - pe) / (1 - pe)).alias("Kappa"),
        F.when(mcc_den > 0, (F.col("c") * s - F.col("tq")) / mcc_den).otherwise(0.0).alias("MCC"),
    )


def scores(df: DataFrame, y: str, p: str, operation: str, average: str = "macro", by: list[str] | None = None) -> DataFrame:
    if operation == "regression":
        return regression_scores(df, y, p, by)
    return classification_scores(df, y, p, average, by)


def with_absolute(scores_table: DataFrame, metrics: list[str]) -> DataFrame:
    """Signed scores plus abs_<metric>."""
    return scores_table.withColumns({f"abs_{m}": F.abs(col(m)) for m in metrics})


def mean_scores(table: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return table.groupBy(*by).agg(*[F.avg(col(m)).alias(m) for m in metrics])


def model_spread(table: DataFrame, by: list[str], metric: str) -> DataFrame:
    """(by..., mean, sd) with the sample standard deviation."""
    return table.groupBy(*by).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"))


def corrected_t_test(first: DataFrame, second: DataFrame, metric: str, folds: int, n: int | None = None, on: tuple[str, ...] = ("rep", "fold")) -> DataFrame:
    """Corrected repeated k-fold t-test on paired fold scores: (t_statistic, df, p_value, cohens_d).

    ``n`` defaults to the number of score pairs.
    """
    pair = first.select(*on, F.col(metric).alias("a")).join(second.select(*on, F.col(metric).alias("b")), list(on))
    s = pair.agg(F.avg(F.col("a") - F.col("b")).alias("d"), F.var_pop(F.col("a") - F.col("b")).alias("v"), F.count("*").alias("pairs"))
    size = F.lit(n).cast("double") if n is not None else F.col("pairs").cast("double")
    t = F.try_divide(F.col("d"), F.sqrt(F.col("v") * (1 / size + F.lit(1.0 / (folds - 1)))))
    return s.select(t.alias("t_statistic"), (size - 1).alias("df"), F.try_divide(F.abs(2 * t), F.sqrt(size - 1)).alias("cohens_d")).withColumn(
        "p_value", t_two_sided_udf("t_statistic", "df")
    )


def trial_history(trials: DataFrame, maximise: bool = True) -> DataFrame:
    """Trials with the best value so far; the trial table has at most a few hundred rows."""
    from pyspark.sql import Window

    w = Window.orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)
    return trials.withColumn("best", (F.max if maximise else F.min)("value").over(w))


def trial_slices(trials: DataFrame) -> DataFrame:
    """(trial, param, param_value, value) from the params map."""
    return trials.select("trial", F.explode("params").alias("param", "param_value"), "value")
