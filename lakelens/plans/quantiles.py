"""Exact quantiles (linear interpolation) without gathering a column in one task.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. Here a bounded sketch
(``percentile_approx``) first brackets each wanted order statistic; the exact aggregate then runs over
values clamped to the bracket, so its buffer holds only the few distinct values inside. Counts below and
above the bracket prove that the wanted order statistics lie inside; if not, or if the bracket still
holds too many rows, the bracket is refined. Each step is one aggregate with map-side combine.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.functions.columns import col, number
from lakelens.plans.session import BROADCAST_ROWS

ACCURACY = 10_000
MARGIN = 3  # bracket half width in units of the sketch error
MAX_INSIDE = 1_000_000  # rows that may lie inside a bracket when the exact aggregate runs


def _clip(p: float) -> float:
    return min(1.0, max(0.0, p))


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    accuracy: int = ACCURACY,
    max_inside: int = MAX_INSIDE,
) -> dict[str, list[float | None]]:
    """Quantiles of whole columns as a dict column -> values (NULL / NaN are skipped)."""
    if not columns:
        return {}
    x = {c: number(df, c) for c in columns}
    eps = MARGIN / accuracy
    lows, highs = [_clip(p - eps) for p in probs], [_clip(p + eps) for p in probs]
    aggs = []
    for i, c in enumerate(columns):
        aggs += [
            F.count(x[c]).alias(f"n{i}"),
            F.percentile_approx(x[c], lows + highs, accuracy).alias(f"q{i}"),
        ]
    first = df.agg(*aggs).first()
    n = {c: first[f"n{i}"] for i, c in enumerate(columns)}
    bracket = {}
    for i, c in enumerate(columns):
        if n[c]:
            q = first[f"q{i}"]
            for j in range(len(probs)):
                bracket[c, j] = (q[j], q[j + len(probs)])
    width = {k: 2 * eps * n[k[0]] for k in bracket}
    wide = [k for k in bracket if width[k] > max_inside and bracket[k][0] < bracket[k][1]]
    _narrow(df, x, n, probs, bracket, width, wide, accuracy, max_inside)
    result, failed = _inside(df, x, n, probs, bracket)
    if failed:  # a sketch outside its stated error: fall back to the full range, refined by counting
        ends = df.agg(*[F.struct(F.min(x[c]), F.max(x[c])).alias(f"e{i}") for i, c in enumerate(columns)]).first()
        for c, j in failed:
            bracket[c, j] = tuple(ends[f"e{columns.index(c)}"])
        for k in failed:
            width[k] = n[k[0]]
        _narrow(df, x, n, probs, bracket, width, list(failed), accuracy, max_inside)
        again, bad = _inside(df, x, n, probs, {k: bracket[k] for k in failed})
        if bad:
            raise RuntimeError(f"quantile bracket could not be confirmed for {bad}")
        result.update(again)
    return {c: [result.get((c, j)) for j in range(len(probs))] for c in columns}


def _narrow(df, x, n, probs, bracket, width, keys, accuracy, max_inside, rounds=40):
    while keys and rounds:
        _refine(df, x, n, probs, bracket, width, keys, accuracy)
        keys = [k for k in keys if width[k] > max_inside and bracket[k][0] < bracket[k][1]]
        rounds -= 1


def _refine(df, x, n, probs, bracket, width, keys, accuracy):
    """Narrow brackets: count the rows strictly inside, then sketch only those.

    A value with very many rows becomes an end of its bracket, where copies do not count, so the inside
    shrinks by the sketch error in every round whatever the skew.
    """
    aggs = []
    for i, k in enumerate(keys):
        lo, hi = bracket[k]
        v = x[k[0]]
        aggs += [F.count(F.when(v <= lo, 1)).alias(f"b{i}"), F.count(F.when((v > lo) & (v < hi), 1)).alias(f"m{i}")]
    counts = df.agg(*aggs).first()
    aggs, wanted, eps = [], {}, MARGIN / accuracy
    for i, k in enumerate(keys):
        lo, hi = bracket[k]
        below, m = counts[f"b{i}"], counts[f"m{i}"]
        width[k] = m
        if m:
            rank = math.floor(probs[k[1]] * (n[k[0]] - 1))
            wanted[k] = ((rank - below) / m - eps, (rank + 2 - below) / m + eps)
            inner = F.when((x[k[0]] > lo) & (x[k[0]] < hi), x[k[0]])
            aggs.append(F.percentile_approx(inner, [_clip(p) for p in wanted[k]], accuracy).alias(f"q{i}"))
    if not aggs:
        return
    found = df.agg(*aggs).first()
    for i, k in enumerate(keys):
        if k in wanted:
            lo, hi = bracket[k]
            low, high = wanted[k]
            q = found[f"q{i}"]
            bracket[k] = (q[0] if low > 0 else lo, q[1] if high < 1 else hi)
            width[k] = min(width[k], 2 * eps * width[k] + 2)


def _inside(df, x, n, probs, bracket):
    aggs = []
    keys = list(bracket)
    if not keys:
        return {}, []
    for i, k in enumerate(keys):
        lo, hi = bracket[k]
        v = x[k[0]]
        aggs += [
            F.percentile(F.when(v.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), v))), probs[k[1]]).alias(f"v{i}"),
            F.count(F.when(v < lo, 1)).alias(f"b{i}"),
            F.count(F.when(v <= hi, 1)).alias(f"h{i}"),
        ]
    row = df.agg(*aggs).first()
    result, failed = {}, []
    for i, k in enumerate(keys):
        rank = probs[k[1]] * (n[k[0]] - 1)
        if row[f"b{i}"] <= math.floor(rank) and row[f"h{i}"] >= math.ceil(rank) + 1:
            result[k] = row[f"v{i}"]
        else:
            failed.append(k)
    return result, failed


def exact_quantiles_by(
    df: DataFrame,
    by: list[str],
    column: str,
    probs: list[float],
    accuracy: int = ACCURACY,
    max_inside: int = MAX_INSIDE,
) -> DataFrame:
    """Quantiles of one column per group: (by..., n, q array). Groups without values are left out.

    Groups so large that their bracket would hold more than ``max_inside`` rows are few (each holds at
    least max_inside * accuracy / 6 rows) and take the whole-column path one by one.
    """
    eps = MARGIN / accuracy
    k = len(probs)
    rows = df.select(*[col(b).alias(b) for b in by], number(df, column).alias("__x")).where("__x IS NOT NULL")
    br = (
        rows.groupBy(*by)
        .agg(
            F.count("*").alias("n"),
            F.percentile_approx("__x", [_clip(p - eps) for p in probs] + [_clip(p + eps) for p in probs], accuracy).alias("__q"),
        )
        .persist()
    )
    groups, biggest = br.agg(F.count("*"), F.max("n")).first()
    hot_limit = max_inside / (2 * eps)
    side = br.where(F.col("n") <= hot_limit)
    pair = F.broadcast(side) if groups <= BROADCAST_ROWS else side
    joined = rows.join(pair.withColumnsRenamed({b: f"__{b}" for b in by}), _pairs(by))
    aggs = [F.first("n").alias("n")]
    for j in range(k):
        lo, hi = F.col("__q")[j], F.col("__q")[j + k]
        aggs += [
            F.percentile(F.greatest(lo, F.least(hi, F.col("__x"))), probs[j]).alias(f"__v{j}"),
            F.count(F.when(F.col("__x") < lo, 1)).alias(f"__b{j}"),
            F.count(F.when(F.col("__x") <= hi, 1)).alias(f"__h{j}"),
        ]
    ok = F.lit(True)
    for j, p in enumerate(probs):
        rank = F.lit(p) * (F.col("n") - 1)
        ok = ok & (F.col(f"__b{j}") <= F.floor(rank)) & (F.col(f"__h{j}") >= F.ceil(rank) + 1)
    res = joined.groupBy(*by).agg(*aggs).withColumn("__ok", ok).persist()
    out = res.where("__ok").select(*by, "n", F.array(*[F.col(f"__v{j}") for j in range(k)]).alias("q"))
    redo = [tuple(g) for g in res.where("NOT __ok").select(*by).collect()]
    if biggest and biggest > hot_limit:
        redo += [tuple(g) for g in br.where(F.col("n") > hot_limit).select(*by).collect()]
    for g in redo:
        one = rows
        for b, v in zip(by, g):
            one = one.where(F.col(b).eqNullSafe(F.lit(v)))
        q = exact_quantiles(one, ["__x"], probs, accuracy, max_inside)["__x"]
        extra = br.select(*by, "n")
        for b, v in zip(by, g):
            extra = extra.where(F.col(b).eqNullSafe(F.lit(v)))
        out = out.unionByName(extra.withColumn("q", F.array(*[F.lit(v) for v in q])))
    return out


def _pairs(by: list[str]):
    cond = F.lit(True)
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"__{b}"))
    return cond
