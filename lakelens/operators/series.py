"""Time series: resampling, decomposition and stationarity tests.

A series is cut into time blocks that carry a halo of neighbouring rows, so moving averages and lag sums
of one very long series run in many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelens.functions.columns import col
from lakelens.functions.dist import norm_cdf
from lakelens.plans.ranking import running_totals
from lakelens.plans.session import cut

BLOCK = 20_000

# Published critical values and response-surface coefficients.
KPSS_POINTS = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
ADF_CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_SWITCH, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74


def resample(df: DataFrame, ts: str, value: str, every: str = "1 hour", keys: list[str] | None = None, fill: bool = True) -> DataFrame:
    """(keys..., ts, value): sums per time bucket; empty buckets inside a series' span get 0."""
    keys = list(keys or [])
    sums = df.groupBy(*keys, F.window(col(ts), every).alias("__w")).agg(F.sum(value).alias("__v"))
    sums = sums.select(*keys, F.col("__w.start").alias("ts"), F.col("__v").alias("value"))
    if not fill:
        return sums
    sums = sums.persist()
    span = sums.groupBy(*keys).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = span.select(*keys, F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {every}"))).alias("ts"))
    return grid.join(sums, [*keys, "ts"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def with_position(df: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    """Add ``pos`` = 0, 1, ... in time order within each series (one row per time stamp)."""
    stamp = F.unix_micros(col(ts).cast("timestamp"))
    times = df.select(*keys, stamp.alias("__t")).withColumn("__one", F.lit(1))
    pos = running_totals(times, "__t", ["__one"], by=keys)
    return df.withColumn("__t", stamp).join(pos.select(*keys, "__t", (F.col("__one_cum") - 1).alias("pos")), [*keys, "__t"]).drop("__t")


def _blocks(df: DataFrame, before: int, after: int, block: int) -> DataFrame:
    """Add ``blk``; rows near a border are repeated in the neighbouring blocks that need them."""
    lo = F.floor((F.col("pos") - after) / block)
    hi = F.floor((F.col("pos") + before) / block)
    return df.withColumn("blk", F.explode(F.sequence(F.greatest(lo, F.lit(0)).cast("long"), hi.cast("long"))))


def decompose(df: DataFrame, ts: str, value: str, period: int, keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """(keys..., ts, observed, trend, seasonal, resid): multiplicative, centred moving average trend."""
    keys = list(keys or [])
    base = df if keys else df.withColumn("__k", F.lit(0))
    by = keys or ["__k"]
    x = with_position(base.select(*by, col(ts).alias("ts"), col(value).cast("double").alias("observed")), "ts", by)
    half = period // 2
    halo = _blocks(x, half, half, max(block, 4 * period))
    w = Window.partitionBy(*by, "blk").orderBy("pos")
    full = w.rowsBetween(-half, half)
    width = 2 * half + 1
    total = F.sum("observed").over(full)
    if period % 2 == 0:
        inner = w.rowsBetween(-half + 1, half - 1)
        total = (total + F.sum("observed").over(inner)) / 2
    own = F.floor(F.col("pos") / max(block, 4 * period)) == F.col("blk")
    t = halo.withColumn("trend", F.when(F.count("observed").over(full) == width, total / period)).where(own).drop("blk")
    t = t.withColumn("phase", F.pmod(F.col("pos"), F.lit(period))).withColumn("ratio", F.try_divide("observed", "trend"))
    phases = t.groupBy(*by, "phase").agg(F.avg("ratio").alias("m"))
    norm = phases.groupBy(*by).agg(F.avg("m").alias("g"))
    seasonal = phases.join(norm, by).select(*by, "phase", F.try_divide("m", "g").alias("seasonal"))
    return t.join(seasonal, [*by, "phase"]).select(*keys, "ts", "observed", "trend", "seasonal", F.try_divide(F.try_divide("observed", "trend"), F.col("seasonal")).alias("resid"))


def _lag_sums(x: DataFrame, by: list[str], lags: int, fn, block: int) -> pd.DataFrame:
    """Sum fn(values, positions of own rows) over blocks with ``lags`` rows of history: (by..., name, i, x).

    Partial sums have a fixed size; they are added per series on the executors. One small matrix per
    series reaches the driver.
    """
    size = max(block, 4 * (lags + 2))
    halo = _blocks(x, lags, 0, size)
    types = {f.name: f.dataType.simpleString() for f in x.schema.fields}
    schema = ", ".join(f"{b} {types[b]}" for b in by) + ", name string, i int, x double"

    def part(pdf):
        pdf = pdf.sort_values("pos")
        start = int(pdf["blk"].iloc[0]) * size
        out = fn(pdf["x"].to_numpy(float), int((pdf["pos"] < start).sum()), int(pdf["pos"].iloc[0]) == 0)
        if not out:  # a block that holds only the history of a series' end
            return pd.DataFrame()
        res = pd.concat([pd.DataFrame({"name": k, "i": range(np.size(m)), "x": np.ravel(m)}) for k, m in out.items()])
        for b in by:
            res[b] = pdf[b].iloc[0]
        return res[[*by, "name", "i", "x"]]

    sums = halo.groupBy(*by, "blk").applyInPandas(part, schema).groupBy(*by, "name", "i").agg(F.sum("x").alias("x"))
    return sums.toPandas()


def _per_series(pdf: pd.DataFrame, by: list[str]):
    for key, g in pdf.groupby(by, dropna=False):
        out = {}
        for name, h in g.groupby("name"):
            h = h.sort_values("i")
            out[name] = h["x"].to_numpy()
        yield key if isinstance(key, tuple) else (key,), out


def _series(df: DataFrame, ts: str, value: str, keys: list[str]) -> tuple[DataFrame, list[str]]:
    base = df if keys else df.withColumn("__k", F.lit(0))
    by = keys or ["__k"]
    x = with_position(base.select(*by, col(ts).alias("ts"), col(value).cast("double").alias("x")), "ts", by)
    return cut(x), by


def kpss(df: DataFrame, ts: str, value: str, keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """(keys..., statistic, p_value, lags, n): level stationarity, data-driven lag length."""
    keys = list(keys or [])
    x, by = _series(df, ts, value, keys)
    stats = x.groupBy(*by).agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    centred = cut(x.join(stats, by).withColumn("x", F.col("x") - F.col("m")).drop("m"))
    sizes = {tuple(r[b] for b in by): r["n"] for r in stats.collect()}
    cum = running_totals(centred.select(*by, "pos", "x"), "pos", ["x"], by=by)
    squares = {tuple(r[b] for b in by): r["s"] for r in cum.groupBy(*by).agg(F.sum(F.col("x_cum") * F.col("x_cum")).alias("s")).collect()}

    def products(lags):
        def fn(v, skip, first):
            own = np.arange(skip, len(v))
            return {"c": np.array([v[own] @ v[own] if j == 0 else v[own[own >= j]] @ v[own[own >= j] - j] for j in range(lags + 1)])}

        return dict(_per_series(_lag_sums(centred, by, lags, fn, block), by))

    short = {k: int(n ** (2 / 9)) for k, n in sizes.items()}
    c = products(max(short.values()))
    lag = {}
    for k, n in sizes.items():
        g = c[k]["c"]
        s0 = g[0] / n + sum(2 * g[j] / n for j in range(1, short[k] + 1))
        s1 = sum(2 * j * g[j] / n for j in range(1, short[k] + 1))
        lag[k] = max(0, min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1))
    c = products(max(lag.values()))
    rows = []
    for k, n in sizes.items():
        g, m = c[k]["c"], lag[k]
        long_run = (g[0] + 2 * sum(g[j] * (1 - j / (m + 1)) for j in range(1, m + 1))) / n
        stat = squares[k] / n**2 / long_run
        p = float(np.interp(stat, [a for a, _ in KPSS_POINTS], [b for _, b in KPSS_POINTS]))
        rows.append((*(k if keys else ()), float(stat), p, int(m), int(n)))
    return _result(x, keys, rows, "statistic double, p_value double, lags int, n long")


def _result(x: DataFrame, keys: list[str], rows: list[tuple], tail: str) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in x.schema.fields}
    return x.sparkSession.createDataFrame(rows, ", ".join([f"{b} {types[b]}" for b in keys] + [tail]))


def _ols(g: np.ndarray, xs: list[int], y: int):
    """Coefficients, inverse and residual sum of squares from a Gram matrix."""
    a = g[np.ix_(xs, xs)]
    inv = np.linalg.pinv(a)
    b = inv @ g[xs, y]
    return b, inv, max(float(g[y, y] - b @ g[xs, y]), 1e-300)


def adf(df: DataFrame, ts: str, value: str, keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """(keys..., statistic, p_value, lags, n_used, critical values): unit root with constant, lag by AIC.

    The regressions of all lag lengths share one Gram matrix of [1, x(t-1), dx(t), dx(t-1), ...] per
    series, which the blocks add up.
    """
    keys = list(keys or [])
    x, by = _series(df, ts, value, keys)
    sizes = {tuple(r[b] for b in by): r["n"] for r in x.groupBy(*by).agg(F.count("*").alias("n")).collect()}
    longest = {k: min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2) for k, n in sizes.items()}

    def grams(lags):
        width = lags + 3

        def fn(v, skip, first):
            rows = np.arange(max(skip, lags + 1), len(v))  # needs x(t-1-lags)
            if not len(rows):
                return {}
            d = np.diff(v, prepend=np.nan)
            z = np.column_stack([np.ones(len(rows)), v[rows - 1], d[rows], *[d[rows - j] for j in range(1, lags + 1)]])
            return {"g": z.T @ z}

        got = dict(_per_series(_lag_sums(x, by, lags + 1, fn, block), by))
        return {k: v["g"].reshape(width, width) for k, v in got.items()}

    best: dict = {}
    for m in sorted(set(longest.values())):
        g = grams(m)
        for k, lim in longest.items():
            if lim != m:
                continue
            n = g[k][0, 0]
            aic = []
            for j in range(m + 1):
                xs = [0, 1, *range(3, 3 + j)]
                rss = _ols(g[k], xs, 2)[2]
                aic.append(n * (math.log(2 * math.pi) + math.log(rss / n) + 1) + 2 * len(xs))
            best[k] = int(np.argmin(aic))
    rows = []
    for m in sorted(set(best.values())):
        g = grams(m)
        for k in [k for k, b in best.items() if b == m]:
            xs = [0, 1, *range(3, 3 + m)]
            b, inv, rss = _ols(g[k], xs, 2)
            n = g[k][0, 0]
            t = b[1] / math.sqrt(rss / (n - len(xs)) * inv[1, 1])
            crit = [sum(c / n**i for i, c in enumerate(cs)) for cs in ADF_CRITICAL.values()]
            rows.append((*(k if keys else ()), float(t), _adf_p(t), m, int(n), *map(float, crit)))
    return _result(x, keys, rows, "statistic double, p_value double, lags int, n_used long, crit_1 double, crit_5 double, crit_10 double")


def _adf_p(t: float) -> float:
    if t > ADF_MAX:
        return 1.0
    if t < ADF_MIN:
        return 0.0
    cs = ADF_SMALL_P if t <= ADF_SWITCH else ADF_LARGE_P
    return norm_cdf(sum(c * t**i for i, c in enumerate(cs)))
