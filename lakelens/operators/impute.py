"""Forest imputation by chained equations, with fitted models that save and load.

``miss_forest`` repeats rounds of forests until the change between two written tables rises. ``mice_forest`` takes
the values of donors whose predictions are nearest, from a donor table that the fitted model owns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from importlib import import_module

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelens.functions.columns import col, is_missing, number, text
from lakelens.operators import forests
from lakelens.operators.prep import fill, fill_values, modes
from lakelens.plans.ranking import running_totals
from lakelens.plans.session import cut, forget, lookup

SEED = 123
DONORS = 5  # nearest donors that a value is taken from
POOL = 64  # donors with one and the same prediction that are kept, in hash order
MISS_ROUNDS, MICE_ROUNDS = 20, 2
WHOLE = 50  # with fewer observed rows every tree learns from all of them
FEW, MANY = 10_000, 250_000  # rows of a part: at least and at most, as far as the cores can use more parts


class _Settings(Params):
    nums = Param(Params._dummy(), "nums", "numeric columns", typeConverter=TypeConverters.toListString)
    cats = Param(Params._dummy(), "cats", "categorical columns", typeConverter=TypeConverters.toListString)
    method = Param(Params._dummy(), "method", "miss_forest or mice_forest", typeConverter=TypeConverters.toString)
    rounds = Param(Params._dummy(), "rounds", "chained rounds at most; 0: 20 for miss_forest, 2 for mice_forest", typeConverter=TypeConverters.toInt)


def dealt(df: DataFrame, n: int) -> DataFrame:
    """``n`` prepared rows in parts that use all cores, however few files they came from; rows are in the order of their hash, so a rerun draws the same bags."""
    parts = max(min(df.sparkSession.sparkContext.defaultParallelism, n // FEW), math.ceil(n / MANY))
    return df.repartition(parts).sortWithinPartitions("__id") if parts > 1 else df


# ---------------------------------------------------------------- donors


def donor_pools(scored: DataFrame, prediction: str, value: str, key: str = "__id") -> DataFrame:
    """(p, pool): for each distinct prediction the observed values of its donors, at most POOL in hash order.

    The limit by rank works before the shuffle, so a prediction that a third of the rows share stays cheap.
    """
    order = Window.partitionBy("p").orderBy(F.xxhash64(key, "v"), "v")
    rows = scored.select((F.col(prediction) + F.lit(0.0)).alias("p"), F.col(value).alias("v"), key)
    return rows.withColumn("i", F.row_number().over(order)).where(F.col("i") <= POOL).groupBy("p").agg(F.array_sort(F.collect_list("v")).alias("pool"))


def nearest_donors(asked: DataFrame, donors: DataFrame, k: int = DONORS) -> DataFrame:
    """(p, n, pool) for (p, n): the values of the k donors with the nearest predictions; all donors with p itself if there are k of them.

    Distinct predictions of both sides are put in one order by running totals over ranges; the place of a prediction among
    those of the donors names its k neighbours on either side, which come by a join on their place. No prediction is
    compared with all others, and no task holds the whole order.
    """
    places = donors.select("p", F.lit(1).alias("w")).unionByName(asked.select("p", F.lit(0).alias("w"))).groupBy("p").agg(F.sum("w").alias("w"))
    places = cut(running_totals(places, "p", ["w"]))
    ranked = donors.join(places.where("w = 1").select("p", F.col("w_cum").alias("at")), "p").select("at", F.col("p").alias("of"), "pool")
    near = asked.join(places.select("p", "w_cum"), "p").select("p", "n", F.explode(F.sequence(F.col("w_cum") - k, F.col("w_cum") + k)).alias("at"))
    found = near.join(ranked, "at").groupBy("p", "n").agg(F.array_sort(F.collect_list(F.struct(F.abs(F.col("of") - F.col("p")).alias("d"), "of", "pool"))).alias("c"))
    first = F.col("c")[0]
    own = (first["d"] == 0) & (F.size(first["pool"]) >= k)
    return found.select("p", "n", F.when(own, first["pool"]).otherwise(F.slice(F.flatten(F.transform("c", lambda x: x["pool"])), 1, k)).alias("pool"))


# ---------------------------------------------------------------- one fitted column


@dataclass
class Stage:
    """The forest of one column, the labels of a category, and the donors of a number where values are taken from donors."""

    target: str
    model: object
    labels: list[str] | None
    drawn: bool
    donors: DataFrame | None = None

    def score(self, df: DataFrame, nums: list[str], cats: list[str]) -> DataFrame:
        return self.model.transform(_vector(df, self.target, nums, cats))

    def apply(self, df: DataFrame, nums: list[str], cats: list[str]) -> DataFrame:
        """``df`` with the gaps of ``target`` (``__na_``) filled anew. Where values are drawn, ``df`` is a written table and only rows with a gap are scored."""
        c, na = self.target, F.col(f"__na_{self.target}")
        if self.drawn and not df.isStreaming:
            return df.where(~na).unionByName(self._filled(df.where(na), nums, cats))
        return self._filled(df, nums, cats)

    def _filled(self, df: DataFrame, nums: list[str], cats: list[str]) -> DataFrame:
        c, na = self.target, F.col(f"__na_{self.target}")
        names = df.columns
        scored = self.score(df, nums, cats)
        if self.labels is not None:
            code = F.col("__p")
            if self.drawn:  # a class by its probability, from a hash of the row
                u = F.pmod(F.xxhash64("__id", F.lit(c)), F.lit(1 << 20)) / F.lit(float(1 << 20))
                zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k"))
                step = lambda a, x: F.struct((a["s"] + x).alias("s"), (a["k"] + (a["s"] + x <= u).cast("int")).alias("k"))
                code = F.least(F.aggregate(vector_to_array("__prob"), zero, step)["k"], F.lit(len(self.labels) - 1)).cast("double")
            word = F.get(F.array(*[F.lit(v) for v in self.labels]), code.cast("int"))
            return scored.withColumns({c: F.when(na, word).otherwise(col(c)), f"__ix_{c}": F.when(na, code).otherwise(F.col(f"__ix_{c}"))}).select(*[col(x) for x in names])
        if not self.drawn:
            return scored.withColumn(c, F.when(na, F.col("__p")).otherwise(number(df, c))).select(*[col(x) for x in names])
        scored = cut(scored.withColumn("p", F.col("__p") + F.lit(0.0)).select(*[col(x) for x in names], "p"))
        asked = scored.groupBy("p").agg(F.count("*").alias("n"))
        pools = cut(nearest_donors(asked, self.donors))
        pick = F.get("pool", F.pmod(F.xxhash64("__id", F.lit(c)), F.size("pool")).cast("int"))
        return lookup(scored, pools, "p", "n").withColumn(c, pick).select(*[col(x) for x in names])


def _slot(c: str, cats: list[str]) -> str:
    return f"__ix_{c}" if c in cats else c


def _vector(df: DataFrame, target: str, nums: list[str], cats: list[str]) -> DataFrame:
    others = [_slot(c, cats) for c in nums + cats if c != target]
    if not others:  # a lone column: its forest is its mean or majority
        df, others = df.withColumn("__one", F.lit(1.0)), ["__one"]
    return VectorAssembler(inputCols=others, outputCol="__x", handleInvalid="keep").transform(df)


def _learn(df: DataFrame, target: str, nums: list[str], cats: list[str], indexers: dict, mice: bool) -> Stage:
    """A forest on the rows in which ``target`` was observed, with the others as they are now."""
    seen = df.where(~F.col(f"__na_{target}"))
    bins = max([64, *(len(m.labels) + 1 for m in indexers.values())])  # a category each, at least
    trees = dict(trees=50, depth=8, rate=0.63) if mice else dict(trees=4, depth=10, rate=0.5)
    data = _vector(seen, target, nums, cats)
    if len(data.select("__x").take(WHOLE)) < WHOLE:  # a tree without any row would predict 0
        trees = trees | dict(rate=1.0, bootstrap=False)
    labels = list(indexers[target].labels) if target in cats else None
    grown = forests.fit(data, "__x", _slot(target, cats), bins=bins, classes=len(labels or []), seed=SEED, **trees)
    stage = Stage(target, forests.GrownForest.of(grown, featuresCol="__x", predictionCol="__p", probabilityCol="__prob"), labels, mice)
    if labels is not None:
        return stage
    if mice:
        stage.donors = cut(donor_pools(stage.score(seen, nums, cats), "__p", target))
    return stage


def change(df: DataFrame, nums: list[str], cats: list[str]) -> dict[str, float]:
    """How far the filled cells moved since ``__was_``: squared share of the numbers, share of the categories; one aggregate."""
    moved, size, other, cells = F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0)
    for c in nums:
        na = F.col(f"__na_{c}")
        moved = moved + F.when(na, F.pow(col(c) - F.col(f"__was_{c}"), 2)).otherwise(0.0)
        size = size + F.when(na, col(c) * col(c)).otherwise(0.0)
    for c in cats:
        na = F.col(f"__na_{c}").cast("int")
        other = other + na * (~col(c).eqNullSafe(F.col(f"__was_{c}"))).cast("int")
        cells = cells + na
    row = df.agg(F.sum(moved), F.sum(size), F.sum(other), F.sum(cells)).first()
    out = {"numbers": (row[0] or 0.0) / (row[1] or 1.0)} if nums else {}
    return out | ({"categories": (row[2] or 0) / (row[3] or 1)} if cats else {})


# ---------------------------------------------------------------- model and estimator


class _Writer(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        rounds = [[{"target": s.target, "labels": s.labels, "drawn": s.drawn, "donors": s.donors is not None, "kind": type(s.model).__name__} for s in r] for r in m.stages]
        facts = {"start": m.start, "cats_order": list(m.indexers), "stages": rounds, "changes": m.changes}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata=facts)
        for c, indexer in enumerate(m.indexers.values()):
            indexer.write().overwrite().save(f"{path}/indexers/{c}")
        for i, r in enumerate(m.stages):
            for j, s in enumerate(r):
                s.model.write().overwrite().save(f"{path}/stages/{i}_{j}/model")
                if s.donors is not None:
                    s.donors.write.mode("overwrite").parquet(f"{path}/stages/{i}_{j}/donors")


class _Reader(MLReader):
    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        indexers = {c: StringIndexerModel.load(f"{path}/indexers/{k}") for k, c in enumerate(metadata["cats_order"])}
        stages = []
        for i, r in enumerate(metadata["stages"]):
            stages.append([])
            for j, s in enumerate(r):
                where = f"{path}/stages/{i}_{j}"
                where_from = "pyspark.ml.classification" if "Classif" in s["kind"] else "pyspark.ml.regression"  # saved by former versions
                kind = forests.GrownForest if s["kind"] == "GrownForest" else getattr(import_module(where_from), s["kind"])
                donors = self.sparkSession.read.parquet(f"{where}/donors") if s["donors"] else None
                stages[-1].append(Stage(s["target"], kind.load(f"{where}/model"), s["labels"], s["drawn"], donors))
        m = ForestImputerModel(start=metadata["start"], indexers=indexers, stages=stages, changes=metadata["changes"])
        m._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(m, metadata)
        return m


class ForestImputerModel(Model, _Settings, MLWritable, MLReadable):
    """Start values and the fitted columns of each kept round; transform applies them in their order.

    ``changes`` lists how far each round moved the filled cells. A gap in a column that was complete at fit time is filled
    too: the last round has a forest for every column. Null, NaN and categories that were not seen count as they did at
    fit time. ``write()`` stores the forests, indexers and donor tables below the given path, and ``load`` reads them back.
    """

    def __init__(self, nums=None, cats=None, start=None, indexers=None, stages=None, changes=None):
        super().__init__()
        self._set(nums=nums or [], cats=cats or [])
        self.start, self.indexers, self.stages, self.changes = start or {}, indexers or {}, stages or [], changes or []

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader()

    def _transform(self, df: DataFrame) -> DataFrame:
        nums, cats = self.getOrDefault(self.nums), self.getOrDefault(self.cats)
        names = nums + cats
        work = _prepared(df, nums, cats, self.start, self.indexers, keep=df.columns)
        if df.isStreaming:  # which columns have gaps is not known beforehand
            gaps = names
        else:
            row = work.agg(*[F.max(F.col(f"__na_{c}").cast("int")).alias(f"m{i}") for i, c in enumerate(names)], F.count("*")).first() if names else []
            gaps = [c for i, c in enumerate(names) if row[i]]
            work = dealt(work, row[-1]) if gaps and any(s.drawn for r in self.stages for s in r) else work
        held = None
        for r in self.stages:
            for stage in r:
                if stage.target in gaps:
                    if stage.drawn and not df.isStreaming:
                        held, old = cut(work), held
                        forget(*([old] if old is not None else []))
                        work = held
                    work = stage.apply(work, nums, cats)
        return work.select([col(c) for c in df.columns])


def _prepared(df: DataFrame, nums: list[str], cats: list[str], start: dict, indexers: dict, keep: list[str]) -> DataFrame:
    """Columns with gaps marked (``__na_``) and filled with start values, category codes, and a hash of the row as it came."""
    marks = {f"__na_{c}": is_missing(df, c) for c in nums + cats}
    key = F.xxhash64(*[number(df, c) for c in nums], *[text(df, c) for c in cats]) if nums + cats else F.lit(0).cast("long")
    work = df.withColumns({**marks, "__id": key})
    work = work.select([col(c) for c in keep if c not in nums + cats] + [number(df, c).alias(c) for c in nums] + [text(df, c).alias(c) for c in cats] + list(marks) + ["__id"])
    work = fill(work, start)
    for indexer in indexers.values():
        work = indexer.transform(work)
    return work


class ForestImputer(Estimator, _Settings):
    """Each incomplete column is predicted from all others by forests, round after round.

    ``miss_forest``: 4 trees of depth 10 on half of the rows. Columns go in the order of their gaps, fewest first; each
    filled column is written once and the next one learns from it. After a round one aggregate compares the filled
    cells with those before: the squared change of the numbers and the share of changed categories. Rounds end when all of
    these rise (the round before is kept), when nothing moves, or after ``rounds`` (20).

    ``mice_forest``: 50 trees of depth 8, 2 rounds. A number is the observed value of one of the DONORS rows
    with the nearest predictions, chosen by a hash of the row; a category is drawn by its probability with the
    same hash. So filled values are observed ones and a rerun gives the same values. Equal rows are filled alike.

    The last round has a forest for complete columns too. A column without any value stays empty.
    """

    @keyword_only
    def __init__(self, nums=None, cats=None, method="miss_forest", rounds=0):
        super().__init__()
        self._setDefault(nums=[], cats=[], method="miss_forest", rounds=0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df):
        nums, cats = self.getOrDefault(self.nums), self.getOrDefault(self.cats)
        mice = self.getOrDefault(self.method) == "mice_forest"
        rounds = self.getOrDefault(self.rounds) or (MICE_ROUNDS if mice else MISS_ROUNDS)
        names = nums + cats
        if not names:
            return ForestImputerModel()
        row = df.agg(F.count("*").alias("n"), *[F.sum(is_missing(df, c).cast("int")).alias(f"m{i}") for i, c in enumerate(names)]).first()
        gaps = {c: row[f"m{i}"] or 0 for i, c in enumerate(names)}
        known = [c for c in names if gaps[c] < row["n"]]
        nums, cats = [c for c in nums if c in known], [c for c in cats if c in known]
        start = (fill_values(df, nums, "mean") if nums else {}) | modes(df, [], cats)
        raw = _prepared(df, nums, cats, start, {}, keep=[])
        indexers = {c: StringIndexer(inputCol=c, outputCol=f"__ix_{c}", handleInvalid="keep", stringOrderType="alphabetAsc").fit(raw) for c in cats}
        table = cut(dealt(_prepared(df, nums, cats, start, indexers, keep=[]), row["n"]))
        need = sorted((c for c in known if gaps[c]), key=lambda c: gaps[c])
        parts = [c for c in nums if c in need], [c for c in cats if c in need]
        stages, changes, first = [], [], table
        for _ in range(rounds if need else 0):
            new, fitted = table.drop(*[c for c in table.columns if c.startswith("__was_")]), []
            new = new.withColumns({f"__was_{c}": col(c) for c in need})
            held = table
            for c in need:
                fitted.append(_learn(new, c, nums, cats, indexers, mice))
                new = cut(fitted[-1].apply(new, nums, cats))
                if held is not table:
                    forget(held)
                held = new
            changes.append(change(new, *parts))
            worse = len(changes) > 1 and all(changes[-1][k] > changes[-2][k] for k in changes[-1])
            if worse and not mice:
                forget(new)
                break
            stages.append(fitted)
            forget(table)
            table = new
            if not mice and not any(changes[-1].values()):
                break
        rest = [c for c in known if c not in need]
        stages.append([_learn(table, c, nums, cats, indexers, mice) for c in rest])
        forget(table, first)
        return ForestImputerModel(nums, cats, start, indexers, stages, changes)
