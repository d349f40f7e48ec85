"""Imputation, scaling and encoding as pyspark.ml estimators plus plain column functions.

Each estimator learns a handful of numbers or category lists per column with one or two aggregates and
keeps them as Params; long lists of levels are tables that the model owns. Both are saved and loaded with a pipeline.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.functions.columns import col, is_missing, number, roles, text
from lakelens.plans.quantiles import exact_quantiles
from lakelens.plans.ranking import numbered
from lakelens.plans.session import BROADCAST_ROWS, cut

# Option names.
NUM_IMPUTATION = ("mean", "median", "most_frequent", "miss_forest", "mice_forest", None)
CAT_IMPUTATION = ("most_frequent", "miss_forest", "mice_forest", None)
SCALERS = ("maxabs", "minmax", "robust", "yeo_johnson", "zscore", None)
RARE = "infrequent_sklearn"


# ---------------------------------------------------------------- column statistics


def modes(df: DataFrame, nums: list[str], cats: list[str]) -> dict[str, object]:
    """Most frequent value per column (ties: the smallest), from one shuffle of pre-aggregated values."""
    if not nums and not cats:
        return {}
    none = F.lit(None)
    pairs = [F.struct(F.lit(c).alias("variable"), number(df, c).alias("x"), none.cast("string").alias("s")) for c in nums]
    pairs += [F.struct(F.lit(c).alias("variable"), none.cast("double").alias("x"), text(df, c).alias("s")) for c in cats]
    counts = (
        df.select(F.explode(F.array(*pairs)).alias("p"))
        .select("p.*")
        .where("x IS NOT NULL OR s IS NOT NULL")
        .groupBy("variable", "x", "s")
        .agg(F.count("*").alias("n"))
    )
    best = counts.groupBy("variable").agg(F.min_by(F.struct("x", "s"), F.struct(-F.col("n"), F.col("x"), F.col("s"))).alias("b"))
    found = {row["variable"]: (row["b"]["x"] if row["b"]["s"] is None else row["b"]["s"]) for row in best.collect()}
    return {c: found.get(c) for c in nums + cats}


def columns_with_missing(df: DataFrame, columns: list[str]) -> list[str]:
    if not columns:
        return []
    row = df.agg(*[F.max(is_missing(df, c).cast("int")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"m{i}"] == 1]


def fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Replace missing cells; numeric columns with a filled value become double."""
    out = {}
    for c, v in values.items():
        if v is None:
            continue
        out[c] = F.coalesce(number(df, c), F.lit(float(v))) if isinstance(v, (int, float)) else F.coalesce(text(df, c), F.lit(v))
    return df.withColumns(out) if out else df


def fill_modes(df: DataFrame, nums: list[str], cats: list[str]) -> DataFrame:
    need = set(columns_with_missing(df, nums + cats))
    return fill(df, modes(df, [c for c in nums if c in need], [c for c in cats if c in need]))


def fill_values(df: DataFrame, columns: list[str], strategy: str) -> dict[str, float]:
    if strategy == "mean":
        row = df.agg(*[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        return {c: row[f"m{i}"] for i, c in enumerate(columns)}
    if strategy == "median":
        return {c: q[0] for c, q in exact_quantiles(df, columns, [0.5]).items()}
    if strategy == "most_frequent":
        return modes(df, columns, [])
    raise ValueError(f"unknown strategy {strategy}")


def yeo_johnson(x, lam: float):
    """Yeo-Johnson transform as a column expression for one lambda."""
    pos = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    neg = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, pos).when(x < 0, neg)


def yeo_johnson_lambdas(df: DataFrame, columns: list[str], rounds: int = 4) -> dict[str, float]:
    """Maximum-likelihood lambda per column: the profile likelihood on a grid is ONE aggregate, refined."""
    grid = {c: np.linspace(-3.0, 5.0, 25) for c in columns}
    best: dict[str, float] = {}
    for _ in range(rounds):
        aggs = []
        for i, c in enumerate(columns):
            x = number(df, c)
            aggs.append(F.struct(F.count(x), F.sum(F.signum(x) * F.log1p(F.abs(x)))).alias(f"l{i}"))
            aggs += [F.var_pop(yeo_johnson(x, float(lam))).alias(f"v{i}_{j}") for j, lam in enumerate(grid[c])]
        row = df.agg(*aggs).first()
        for i, c in enumerate(columns):
            n, s = row[f"l{i}"]
            ll = [
                -0.5 * n * math.log(v) + (lam - 1) * s if v is not None and v > 0 else -math.inf
                for lam, v in ((lam, row[f"v{i}_{j}"]) for j, lam in enumerate(grid[c]))
            ]
            j = int(np.argmax(ll))
            step = grid[c][1] - grid[c][0]
            best[c] = float(grid[c][j])
            if 0 < j < len(ll) - 1 and all(map(math.isfinite, ll[j - 1 : j + 2])):
                curve = ll[j - 1] - 2 * ll[j] + ll[j + 1]
                if curve < 0:
                    best[c] += step * 0.5 * (ll[j - 1] - ll[j + 1]) / curve
            grid[c] = np.linspace(best[c] - 1.5 * step, best[c] + 1.5 * step, 13)
    return best


def scale_parameters(df: DataFrame, columns: list[str], method: str) -> dict[str, tuple[float, float]]:
    """(centre, scale) per column; a zero scale counts as 1."""
    if method == "robust":
        q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        return {c: (v[1], (v[2] - v[0]) or 1.0) if v[1] is not None else (0.0, 1.0) for c, v in q.items()}
    x = [number(df, c) for c in columns]
    if method == "zscore":
        row = df.agg(*[F.struct(F.avg(v), F.stddev_pop(v), F.min(v) == F.max(v)).alias(f"s{i}") for i, v in enumerate(x)]).first()
        return {c: (row[f"s{i}"][0] or 0.0, 1.0 if row[f"s{i}"][2] else (row[f"s{i}"][1] or 1.0)) for i, c in enumerate(columns)}
    row = df.agg(*[F.struct(F.min(v), F.max(v), F.max(F.abs(v))).alias(f"s{i}") for i, v in enumerate(x)]).first()
    if method == "minmax":
        return {c: (row[f"s{i}"][0] or 0.0, ((row[f"s{i}"][1] or 0.0) - (row[f"s{i}"][0] or 0.0)) or 1.0) for i, c in enumerate(columns)}
    if method == "maxabs":
        return {c: (0.0, row[f"s{i}"][2] or 1.0) for i, c in enumerate(columns)}
    raise ValueError(f"unknown scaler {method}")


INLINE_LEVELS = 1_000  # levels that are written into expressions; longer lists are tables


def category_levels(df: DataFrame, columns: list[str], min_share: float = 0.05) -> tuple[dict[str, dict], dict[str, DataFrame]]:
    """Per column the kept categories (sorted) and the rare ones, and tables of the rare ones where they are many.

    Categories below ``min_share`` of the rows are pooled, so at most 1/min_share are kept. Up to INLINE_LEVELS rare ones
    are a list; more stay a written table (value, n), so that a rare value is told from an unknown one at every size.
    """
    from lakelens.operators.profile import value_counts

    counts = cut(value_counts(df, columns, keep_missing=False))
    total = df.count()
    kept = F.col("n") >= min_share * total
    summary = counts.groupBy("variable").agg(
        F.count("*").alias("levels"), F.collect_list(F.when(kept, F.col("value"))).alias("kept"), F.sum(F.when(kept, 0).otherwise(1)).alias("rare")
    )
    found = {r["variable"]: r for r in summary.collect()}
    out = {c: {"kept": sorted(found[c]["kept"]) if c in found else [], "rare": [], "levels": found[c]["levels"] if c in found else 0, "has_rare": c in found and found[c]["rare"] > 0} for c in columns}
    few = [c for c in columns if out[c]["has_rare"] and found[c]["rare"] <= INLINE_LEVELS]
    if few:
        for row in counts.where(F.col("variable").isin(few) & ~kept).collect():
            out[row["variable"]]["rare"].append(row["value"])
    for c in few:
        out[c]["rare"].sort()
    many = [c for c in columns if out[c]["has_rare"] and c not in few]
    return out, {c: cut(counts.where((F.col("variable") == c) & ~kept).select("value", "n")) for c in many}


def _flag(df: DataFrame, value, skip, table: DataFrame, names: dict[str, str]) -> DataFrame:
    """``df`` with the columns ``names`` of the row of ``table`` whose value equals ``value``, null where there is none.

    A table of at most BROADCAST_ROWS rows is broadcast. Beyond that only rows for which ``skip`` does not hold are shuffled.
    """
    table = table.select(F.col("value").alias("__level"), *[F.col(a).alias(b) for a, b in names.items()])
    if table.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(table), value == F.col("__level"), "left").drop("__level")
    rest = F.coalesce(skip, F.lit(True))
    joined = df.where(~rest).join(table, value == F.col("__level"), "left").drop("__level")
    return df.where(rest).withColumns({b: F.lit(None).cast(table.schema[b].dataType) for b in names.values()}).unionByName(joined)


def one_hot(df: DataFrame, column: str, spec: dict, rare: DataFrame | None = None) -> DataFrame:
    """Adds <column>_<category> as 0/1; the first of two categories is dropped, rare ones share one column and
    values that were unknown at fit time give all zeros, however many levels there are."""
    c, names = text(df, column), list(spec["kept"])
    levels = names + ([RARE] if spec["has_rare"] else [])
    if len(levels) == 2:
        levels = levels[1:]
    out = {}
    for v in levels:
        if v == RARE and spec["has_rare"]:
            hit = F.col("__rare").isNotNull() if rare is not None else c.isin(spec["rare"])
        else:
            hit = c.eqNullSafe(F.lit(v))
        out[f"{column}_{v}"] = F.when(hit, 1.0).otherwise(0.0)
    if rare is not None:
        df = _flag(df, c, c.isNull() | c.isin(names), rare, {"n": "__rare"})
    return df.withColumns(out).drop("__rare")


# ---------------------------------------------------------------- estimators


class _Columns(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns", typeConverter=TypeConverters.toListString)

    def _names(self):
        return self.getOrDefault(self.inputCols)


class _FittedWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        m = self.instance
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"tables": list(m.tables)})
        for i, t in enumerate(m.tables.values()):
            t.write.mode("overwrite").parquet(f"{path}/tables/{i}")


class _FittedReader(DefaultParamsReader):
    def load(self, path: str):
        m = super().load(path)
        names = DefaultParamsReader.loadMetadata(path, self.sparkSession).get("tables", [])
        m.tables = {c: self.sparkSession.read.parquet(f"{path}/tables/{i}") for i, c in enumerate(names)}
        return m


class _Fitted(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Learned values as a Param, and tables of them by column where they are many; both are saved."""

    fitted = Param(Params._dummy(), "fitted", "learned values per column", typeConverter=TypeConverters.identity)

    def __init__(self):
        super().__init__()
        self.tables: dict[str, DataFrame] = {}

    def learned(self):
        return self.getOrDefault(self.fitted)

    def write(self):
        return _FittedWriter(self)

    @classmethod
    def read(cls):
        return _FittedReader(cls)


class _Learner(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    method = Param(Params._dummy(), "method", "method name", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols=None, method=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _model(self, cls, values, tables=None):
        m = cls()
        m._set(inputCols=self._names(), fitted=values)
        m.tables = tables or {}
        return m


class ImputerModel(_Fitted):
    def _transform(self, df):
        return fill(df, self.learned())


class NumericImputer(_Learner):
    """mean, median (exact) or most_frequent."""

    def _fit(self, df):
        return self._model(ImputerModel, fill_values(df, self._names(), self.getOrDefault(self.method)))


class CategoryImputer(_Learner):
    def _fit(self, df):
        return self._model(ImputerModel, modes(df, [], self._names()))


class ScalerModel(_Fitted):
    def _transform(self, df):
        out = {}
        for c in self._names():
            p = self.learned()[c]
            x = number(df, c) if len(p) == 2 else yeo_johnson(number(df, c), p[2])
            out[c] = (x - F.lit(float(p[0]))) / F.lit(float(p[1]))
        return df.withColumns(out)


class Scaler(_Learner):
    """zscore (population sd), minmax, maxabs, robust (exact quartiles) or yeo_johnson (then zscore)."""

    def _fit(self, df):
        names, method = self._names(), self.getOrDefault(self.method)
        if method != "yeo_johnson":
            return self._model(ScalerModel, {c: list(v) for c, v in scale_parameters(df, names, method).items()})
        lam = yeo_johnson_lambdas(df, names)
        moved = df.select([yeo_johnson(number(df, c), lam[c]).alias(c) for c in names])
        par = scale_parameters(moved, names, "zscore")
        return self._model(ScalerModel, {c: [*par[c], lam[c]] for c in names})


class OneHotModel(_Fitted):
    def output_names(self) -> list[str]:
        names = []
        for c in self._names():
            spec = self.learned()[c]
            levels = list(spec["kept"]) + ([RARE] if spec["has_rare"] else [])
            names += [f"{c}_{v}" for v in (levels[1:] if len(levels) == 2 else levels)]
        return names

    def _transform(self, df):
        for c in self._names():
            df = one_hot(df, c, self.learned()[c], self.tables.get(c))
        return df


class OneHot(_Learner):
    def _fit(self, df):
        return self._model(OneHotModel, *category_levels(df, self._names()))


class AssemblerModel(_Fitted):
    """Vector of the numeric columns followed by the one-hot columns, with names as metadata."""

    def _transform(self, df):
        return VectorAssembler(inputCols=self.learned()["names"], outputCol="features", handleInvalid="keep").transform(df)


class Assembler(_Learner):
    """inputCols are the columns that exist before one-hot encoding; encoded columns carry their prefix."""

    encoded = Param(Params._dummy(), "encoded", "categorical columns", typeConverter=TypeConverters.toListString)
    originals = Param(Params._dummy(), "originals", "columns before encoding", typeConverter=TypeConverters.toListString)

    def _fit(self, df):
        skip = set(self.getOrDefault(self.originals)) if self.isDefined(self.originals) else set()
        names = self._names() + [c for c in df.columns if c not in skip and c not in self._names()]
        return self._model(AssemblerModel, {"names": names})


class LevelsModel(_Fitted):
    """Ordinal codes of sorted labels; ``decode`` gives the labels back. Unknown and missing labels have no code."""

    def _transform(self, df):
        for c in self._names():
            table, levels = self.tables.get(c), self.learned().get(c, [])
            if table is not None:
                v = text(df, c)
                df = _flag(df, v, v.isNull(), table, {"code": f"{c}_code"})
            else:
                code = F.array_position(F.array(*[F.lit(v) for v in levels]).cast("array<string>"), text(df, c))
                df = df.withColumn(f"{c}_code", F.when(code > 0, (code - 1).cast("int")))
        return df

    def decode(self, df, column: str, code: str, out: str):
        table = self.tables.get(column)
        if table is not None:
            labels = table.select(F.col("code").cast("string").alias("value"), F.col("value").alias("label"))
            k = col(code).cast("int").cast("string")
            return _flag(df, k, k.isNull(), labels, {"label": out})
        levels = F.array(*[F.lit(v) for v in self.learned()[column]]).cast("array<string>")
        return df.withColumn(out, F.get(levels, col(code).cast("int")))


class Levels(_Learner):
    """Sorted labels -> 0..k-1. Up to INLINE_LEVELS labels are a list in the model; more are a table that it owns."""

    def _fit(self, df):
        from lakelens.operators.profile import value_counts

        counts = cut(value_counts(df, self._names(), keep_missing=False).select("variable", "value"))
        sizes = {r["variable"]: r["k"] for r in counts.groupBy("variable").agg(F.count("*").alias("k")).collect()}
        seen: dict[str, list[str]] = {c: [] for c in self._names()}
        few = [c for c in seen if sizes.get(c, 0) <= INLINE_LEVELS]
        for row in counts.where(F.col("variable").isin(few)).collect() if few else []:
            seen[row["variable"]].append(row["value"])
        tables = {}
        for c in seen:
            if c not in few:
                codes = numbered(counts.where(F.col("variable") == c).select("value"), ["value"], "code")
                tables[c] = cut(codes.withColumn("code", F.col("code").cast("int")))
        return self._model(LevelsModel, {c: sorted(v) for c, v in seen.items()}, tables)


def data_preprocessing(
    df: DataFrame,
    nums: list[str] | None = None,
    cats: list[str] | None = None,
    imputation_numerical: str | None = "mean",
    scaler: str | None = "zscore",
    imputation_categorical: str | None = "most_frequent",
    one_hot_encoding: bool = True,
) -> Pipeline:
    """Preparation pipeline over the numeric and categorical columns of ``df``; other columns pass through."""
    assert imputation_numerical in NUM_IMPUTATION, f"imputation_numerical must be one of {NUM_IMPUTATION}"
    assert scaler in SCALERS, f"scaler must be one of {SCALERS}"
    assert imputation_categorical in CAT_IMPUTATION, f"imputation_categorical must be one of {CAT_IMPUTATION}"
    assert one_hot_encoding in (True, False), "one_hot_encoding must be True or False"
    from lakelens.operators.impute import ForestImputer

    rl = roles(df)
    nums = rl.num if nums is None else nums
    cats = rl.cat if cats is None else cats
    stages: list = []
    forests = {imputation_numerical, imputation_categorical} & {"miss_forest", "mice_forest"}
    for kind in sorted(forests):
        stages.append(
            ForestImputer(
                nums=nums if imputation_numerical == kind else [], cats=cats if imputation_categorical == kind else [], method=kind
            )
        )
    if nums:
        if imputation_numerical in ("mean", "median", "most_frequent"):
            stages.append(NumericImputer(inputCols=nums, method=imputation_numerical))
        if scaler:
            stages.append(Scaler(inputCols=nums, method=scaler))
    if cats:
        if imputation_categorical == "most_frequent":
            stages.append(CategoryImputer(inputCols=cats))
        if one_hot_encoding:
            stages.append(OneHot(inputCols=cats))
    if one_hot_encoding:
        last = Assembler(inputCols=nums)
        last._set(originals=df.columns)
        stages.append(last)
    return Pipeline(stages=stages)


def feature_names(df: DataFrame, features: str = "features") -> list[str]:
    """Names of the vector slots, read from the column metadata."""
    attrs = df.schema[features].metadata["ml_attr"]["attrs"]
    slots = [a for group in attrs.values() for a in group]
    return [a["name"] for a in sorted(slots, key=lambda a: a["idx"])]
