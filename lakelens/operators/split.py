"""Deterministic splits, folds and bootstrap weights from the md5 of the row id and a seed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelens.functions.columns import col, infer_operation
from lakelens.operators.reshape import quantile_bin
from lakelens.plans.ranking import hash_order, shuffled_row_number

SEED = 123


def with_stratum(df: DataFrame, target: str, bins: int) -> DataFrame:
    """Stratum = the class, or the quantile bin of a numeric target."""
    if infer_operation(df, target) == "regression":
        return quantile_bin(df, target, bins, out="stratum")
    return df.withColumn("stratum", col(target))


def _with_share(df: DataFrame, id_columns: list[str], seed: int, by: list[str]) -> DataFrame:
    """Position of the row within its stratum in hash order, in (0, 1]."""
    ranked = shuffled_row_number(df, id_columns, seed, by=by, total="__n")
    return ranked.withColumn("__share", F.col("shuffle_rank") / F.col("__n")).drop("__n")


def train_test_split(df: DataFrame, target: str, id_columns: list[str], train_size: float = 0.8, seed: int = SEED) -> DataFrame:
    """Add ``is_train``; strata are classes or ten quantile bins."""
    assert 0.5 <= train_size <= 0.95, "train_size must lie in [0.5, 0.95]"
    ranked = _with_share(with_stratum(df, target, 10), id_columns, seed, ["stratum"])
    return ranked.withColumn("is_train", F.col("__share") <= train_size).drop("__share", "shuffle_rank", "stratum")


def k_folds(df: DataFrame, id_columns: list[str], folds: int, seed: int = SEED, target: str | None = None, out: str = "fold") -> DataFrame:
    """Fold number 0..k-1, stratified when a target is given."""
    by = []
    if target is not None:
        df, by = with_stratum(df, target, folds), ["stratum"]
    ranked = shuffled_row_number(df, id_columns, seed, by=by)
    return ranked.withColumn(out, ((F.col("shuffle_rank") - 1) % folds).cast("int")).drop("shuffle_rank", *by)


def repeated_folds(
    df: DataFrame, id_columns: list[str], folds: int = 10, repeats: int = 5, seed: int = SEED, target: str | None = None
) -> DataFrame:
    """One fold column fold_1..fold_r per repetition (seed, seed + 1, ...)."""
    for rep in range(1, repeats + 1):
        df = k_folds(df, id_columns, folds, seed + rep - 1, target, out=f"fold_{rep}")
    return df


def fold_parts(df: DataFrame, fold_column: str, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train, validation) of one fold."""
    return df.where(F.col(fold_column) != fold), df.where(F.col(fold_column) == fold)


def unit_hash(id_columns: list[str], seed: int | str):
    """Uniform number in [0, 1) from the first 52 bits of the md5."""
    return F.conv(F.substring(hash_order(id_columns, seed), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def bootstrap_weights(df: DataFrame, id_columns: list[str], replicate: int, out: str = "weight") -> DataFrame:
    """Poisson(1) multiplicity per row: a bootstrap sample without a shuffle."""
    total, steps = 0.0, []
    for k in range(0, 12):
        total += math.exp(-1.0) / math.factorial(k)
        steps.append(total)
    u = unit_hash(id_columns, replicate)
    return df.withColumn("__u", u).withColumn(out, sum((F.col("__u") >= F.lit(s)).cast("int") for s in steps)).drop("__u")


def learning_subsets(df: DataFrame, id_columns: list[str], fractions: list[float], seed: int = SEED, by: list[str] | None = None) -> list[DataFrame]:
    """Nested training subsets of growing size."""
    ranked = _with_share(df, id_columns, seed, list(by or [])).persist()
    return [ranked.where(F.col("__share") <= f).drop("__share", "shuffle_rank") for f in fractions]
