"""Dense feature helpers: arrays out of vectors, and p x p sums from one pass over the rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.functions.columns import col


def as_array(df: DataFrame, name: str) -> Column:
    """array<double> of an ML vector column or of an array column."""
    if isinstance(df.schema[name].dataType, VectorUDT):
        return vector_to_array(col(name))
    return col(name).cast("array<double>")


def stack(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()) if len(values) else np.empty((0, 0))


def sum_matrices(df: DataFrame, columns: list[Column], fn, names: list[str] | None = None) -> dict[str, np.ndarray]:
    """Sum of small dense arrays that ``fn(pandas batch) -> {name: array}`` computes from each batch.

    Every task adds up its own batches first; the partial sums (a fixed size, p x p per name) are then
    added element-wise by a grouped aggregate and only that sum reaches the driver.
    """

    def part(batches):
        acc: dict[str, np.ndarray] = {}
        for pdf in batches:
            if len(pdf):
                for k, m in fn(pdf).items():
                    acc[k] = acc[k] + m if k in acc else np.array(m, dtype=float)
        for k, m in acc.items():
            yield pd.DataFrame({"name": [k], "shape": [list(m.shape)], "flat": [m.ravel()]})

    parts = df.select(*columns).mapInPandas(part, "name string, shape array<int>, flat array<double>")
    sums = parts.select("name", "shape", F.posexplode("flat").alias("i", "x")).groupBy("name", "i").agg(F.sum("x").alias("x"), F.first("shape").alias("shape"))
    out: dict[str, np.ndarray] = {}
    for name, i, x, shape in sums.collect():
        if name not in out:
            out[name] = np.zeros(tuple(shape)) if shape else np.zeros(())
        out[name].flat[i] = x
    return out


def gram(df: DataFrame, features: str, extra: list[str] | None = None, weight: str | None = None, by: str | None = None) -> dict[str, np.ndarray]:
    """[1 X E]' W [1 X E] per group ('' without groups): counts, sums and cross products in one matrix."""
    extra = list(extra or [])
    cols = [as_array(df, features).alias("v"), *[col(c).cast("double").alias(f"e{i}") for i, c in enumerate(extra)]]
    cols.append((col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    cols.append((col(by).cast("string") if by else F.lit("")).alias("g"))

    def fn(pdf):
        x = stack(pdf["v"])
        e = pdf[[f"e{i}" for i in range(len(extra))]].to_numpy(dtype=float)
        z = np.hstack([np.ones((len(x), 1)), x, e])
        w = pdf["w"].to_numpy(dtype=float)
        return {g: (z[ix] * w[ix, None]).T @ z[ix] for g, ix in pdf.groupby("g").indices.items()}

    return sum_matrices(df, cols, fn)


def moments(g: np.ndarray, ddof: int = 0) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, mean, covariance) from a gram matrix."""
    n = g[0, 0]
    mean = g[0, 1:] / n
    return n, mean, (g[1:, 1:] - n * np.outer(mean, mean)) / (n - ddof)


def array_udf(fn, returns):
    """Arrow-batched function of one array column: fn(matrix) -> vector or matrix of rows."""

    @F.pandas_udf(returns)
    def run(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        out = fn(stack(v))
        return pd.Series(list(out) if getattr(out, "ndim", 1) == 2 else out)

    return run


DOUBLES = T.ArrayType(T.DoubleType())
