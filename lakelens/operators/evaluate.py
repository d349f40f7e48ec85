"""Tables behind model evaluation charts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelens.functions.columns import col
from lakelens.operators.metrics import confusion
from lakelens.plans.ranking import running_totals


def confusion_full(df: DataFrame, y: str, p: str) -> DataFrame:
    """(true, pred, n) with the zero cells of all class pairs."""
    cells = confusion(df, y, p).persist()
    one = cells.select(F.explode(F.array("true", "pred")).alias("c")).distinct()
    classes = one.agg(F.array_sort(F.collect_set("c")).alias("all"))  # one entry per class
    grid = classes.select(F.explode("all").alias("true"), "all").select("true", F.explode("all").alias("pred"))
    return grid.join(cells, ["true", "pred"], "left").na.fill(0, ["n"])


def prediction_counts(df: DataFrame, y: str, p: str, labels: list[str] | None = None) -> DataFrame:
    """Occupied (true, pred, n), decoded when codes 0..k-1 come with their labels."""
    cells = confusion(df, y, p)
    if labels is None:
        return cells
    words = F.array(*[F.lit(v) for v in labels])
    return cells.select(F.get(words, F.col("true").cast("int")).alias("true"), F.get(words, F.col("pred").cast("int")).alias("pred"), "n")


def score_counts(df: DataFrame, y: str, score_of: dict[object, Column], micro: bool = False) -> DataFrame:
    """(class, score, pos, neg): one-vs-rest counts of distinct scores, all classes in one shuffle."""
    parts = []
    for label, s in score_of.items():
        hit = (col(y) == F.lit(label)).cast("long")
        parts.append(F.struct(F.lit(str(label)).alias("class"), s.cast("double").alias("score"), hit.alias("pos"), (1 - hit).alias("neg")))
        if micro:
            parts.append(F.struct(F.lit("micro").alias("class"), s.cast("double").alias("score"), hit.alias("pos"), (1 - hit).alias("neg")))
    return df.select(F.explode(F.array(*parts)).alias("s")).select("s.*").groupBy("class", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def threshold_table(df: DataFrame, y: str, score_of: dict[object, Column], micro: bool = False) -> DataFrame:
    """One row per class and distinct score (descending): counts at and above the threshold and totals.

    ROC, precision-recall, gain, lift, KS and threshold curves all read this table.
    """
    counts = score_counts(df, y, score_of, micro).persist()
    totals = counts.groupBy("class").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    cum = running_totals(counts, "score", ["pos", "neg"], by=["class"], descending=True, few_groups=True)
    return cum.withColumnsRenamed({"pos_cum": "tp", "neg_cum": "fp"}).join(F.broadcast(totals), "class")


def roc_curve(points: DataFrame) -> DataFrame:
    return points.select("class", "score", F.try_divide("fp", "N").alias("fpr"), F.try_divide("tp", "P").alias("tpr"))


def roc_auc(points: DataFrame) -> DataFrame:
    """(class, auc); trapezoid area from each score's own step, no neighbour needed. Adds 'macro'."""
    step = F.try_divide("neg", "N") * F.try_divide(F.col("tp") - F.col("pos") / 2, F.col("P"))
    each = points.groupBy("class").agg(F.sum(step).alias("auc"))
    macro = each.where("class <> 'micro'").agg(F.lit("macro").alias("class"), F.avg("auc").alias("auc"))
    return each.unionByName(macro)


def precision_recall_curve(points: DataFrame) -> DataFrame:
    return points.select(
        "class", "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide("tp", "P").alias("recall")
    )


def average_precision(points: DataFrame) -> DataFrame:
    return points.groupBy("class").agg(F.sum(F.try_divide("pos", "P") * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("average_precision"))


def iso_f1(spark, levels=(0.2, 0.4, 0.6, 0.8), steps: int = 100) -> DataFrame:
    """(f1, recall, precision) lines of equal F1."""
    f1 = F.explode(F.array(*[F.lit(v) for v in levels]))
    base = spark.range(1, steps + 1).select((F.col("id") / steps).alias("recall"), f1.alias("f1"))
    return base.where(F.col("recall") * 2 > F.col("f1")).select("f1", "recall", (F.col("f1") * F.col("recall") / (2 * F.col("recall") - F.col("f1"))).alias("precision")).where("precision <= 1")


def require_binary(df: DataFrame, y: str) -> None:
    if df.select(col(y)).distinct().limit(3).count() != 2:
        raise ValueError("this table is defined for exactly two classes")


def calibration(df: DataFrame, positive: Column, score: Column, bins: int = 5) -> DataFrame:
    """(bin, n, mean_predicted, observed) over uniform bins of the score."""
    b = F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int")
    return df.where(score.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_predicted"), F.avg(positive.cast("double")).alias("observed"))


def gain_curve(points: DataFrame) -> DataFrame:
    """(class, score, share, gain, lift): positives found in the top share of the rows."""
    share = (F.col("tp") + F.col("fp")) / (F.col("P") + F.col("N"))
    gain = F.try_divide("tp", "P")
    return points.select("class", "score", share.alias("share"), gain.alias("gain"), (gain / share).alias("lift"))


def ks_statistic(points: DataFrame) -> DataFrame:
    """(class, ks, threshold): widest gap of the two class score distributions."""
    gap = F.abs(F.try_divide("tp", "P") - F.try_divide("fp", "N"))
    g = points.withColumn("gap", gap)
    return g.groupBy("class").agg(F.max("gap").alias("ks"), F.max_by("score", F.struct("gap", "score")).alias("threshold"))


def threshold_curve(points: DataFrame, steps: int = 100) -> DataFrame:
    """(class, threshold, precision, recall, f1, queue_rate) at fixed thresholds 0..1.

    Each distinct score covers the thresholds up to itself; the step table needs one shuffle of at most
    steps x classes groups.
    """
    slot = F.floor(F.col("score") * steps).cast("int")
    cell = points.groupBy("class", F.least(slot, F.lit(steps)).alias("slot"), "P", "N").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    at = cell.select("class", "P", "N", "pos", "neg", F.explode(F.sequence(F.lit(0), "slot")).alias("k"))
    t = at.groupBy("class", "k", "P", "N").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    return t.select(
        "class",
        (F.col("k") / steps).alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide("tp", "P").alias("recall"),
        (2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("P"))).alias("f1"),
        ((F.col("tp") + F.col("fp")) / (F.col("P") + F.col("N"))).alias("queue_rate"),
    )


def threshold_bands(per_fold: list[DataFrame], probs=(0.1, 0.5, 0.9)) -> DataFrame:
    """Quantiles of the threshold curves across folds (a few rows per threshold)."""
    tagged = [t.withColumn("fold", F.lit(i)) for i, t in enumerate(per_fold)]
    long = reduce(DataFrame.unionByName, tagged).unpivot(["class", "threshold", "fold"], ["precision", "recall", "f1", "queue_rate"], "metric", "value")
    return long.groupBy("class", "threshold", "metric").agg(*[F.percentile("value", p).alias(f"q{int(p * 100)}") for p in probs])


def prediction_error(df: DataFrame, y: str, p: str) -> DataFrame:
    """Best-fit line of prediction on truth and R2 of the model."""
    t, q = col(y).cast("double"), col(p).cast("double")
    return df.agg(
        F.regr_slope(q, t).alias("slope"),
        F.regr_intercept(q, t).alias("intercept"),
        (1 - F.try_divide(F.avg((t - q) * (t - q)), F.var_pop(t))).alias("r2"),
        F.count("*").alias("n"),
    )


def residuals(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.withColumn("residual", col(y).cast("double") - col(p).cast("double"))
