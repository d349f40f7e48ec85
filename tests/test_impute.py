"""Forest imputation: rounds that end by their own change, values of donors, saved models."""

import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from lakelens.operators import impute
from lakelens.operators.impute import ForestImputer, ForestImputerModel
from lakelens.operators.prep import data_preprocessing

SCHEMA = "id long, a double, b double, c string, d double"


def gappy(n=250, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a, d = float(rnd.randrange(40)), float(rnd.randrange(5))
        b, c = 2 * a + d, "lo" if a < 15 else ("mid" if a < 30 else "hi")
        out.append((i, a, None if rnd.random() < 0.2 else b, None if rnd.random() < 0.15 else c, d))
    return out


@pytest.fixture(scope="module")
def rows():
    return gappy()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(2).sortWithinPartitions("id")


def filled(model, df):
    return {r.id: r for r in model.transform(df).collect()}


def test_rounds_end_by_their_change(df, rows):
    m = ForestImputer(nums=["a", "b", "d"], cats=["c"], method="miss_forest", rounds=3).fit(df)
    assert 2 <= len(m.changes) <= 3 and m.changes[1]["numbers"] > 0  # the second round moved values
    kept = len(m.stages) - 1  # the last entry holds the complete columns
    rises = [all(y[k] > x[k] for k in y) for x, y in zip(m.changes, m.changes[1:])]
    assert not any(rises[:-1])
    if len(m.changes) < 3:
        assert (rises[-1] and kept == len(m.changes) - 1) or not any(m.changes[-1].values())
    got = filled(m, df)
    for i, a, b, c, d in rows:
        r = got[i]
        assert (a is None or r.a == a) and (b is None or r.b == b) and (c is None or r.c == c) and r.d == d
        assert None not in (r.a, r.b, r.c)
    wrong = [abs(got[i].b - (2 * a + d)) for i, a, b, c, d in rows if b is None and a is not None]
    assert sum(wrong) / len(wrong) < 8


def test_a_worse_round_is_left_out(spark, df, monkeypatch):
    values = iter([{"numbers": 0.5, "categories": 0.4}, {"numbers": 0.2, "categories": 0.3}, {"numbers": 0.3, "categories": 0.35}])
    monkeypatch.setattr(impute, "change", lambda *_: next(values))
    m = ForestImputer(nums=["a", "b"], cats=["c"], method="miss_forest").fit(df)
    assert len(m.changes) == 3 and len(m.stages) == 3  # two rounds and the complete columns


def test_change_is_over_filled_cells_only(spark):
    t = spark.createDataFrame([(1.0, 9.0, True, "x", "y", False), (3.0, 1.0, False, "x", "y", True), (2.0, 1.0, True, "x", "x", True)], "a double, __was_a double, __na_a boolean, c string, __was_c string, __na_c boolean")
    assert impute.change(t, ["a"], ["c"]) == {"numbers": (64 + 1) / (1 + 4), "categories": 0.5}


@pytest.mark.parametrize("case", [0, 1])
def test_nearest_donors(spark, case):
    rnd = random.Random(case)
    donors = {}
    for _ in range(300):
        p = rnd.choice([0.5, 1.25, round(rnd.uniform(0, 30), 1)])
        donors.setdefault(p, []).append(rnd.randrange(1000) / 4)
    asked = sorted({0.5, -4.0, 99.0, *(round(rnd.uniform(-1, 31), 2) for _ in range(60))})
    table = spark.createDataFrame([(p, sorted(v)) for p, v in donors.items()], "p double, pool array<double>").repartition(3)
    got = {r.p: r.pool for r in impute.nearest_donors(spark.createDataFrame([(p, 1) for p in asked], "p double, n long"), table, 5).collect()}
    assert set(got) == set(asked)
    for p in asked:
        if len(donors.get(p, [])) >= 5:
            assert got[p] == sorted(donors[p])
        else:
            near = sorted((abs(q - p), q) for q in donors)
            assert got[p] == [v for _, q in near for v in sorted(donors[q])][:5]


def test_few_donors_and_hot_predictions(spark):
    table = spark.createDataFrame([(1.0, [4.0])], "p double, pool array<double>")
    assert impute.nearest_donors(spark.createDataFrame([(7.0, 2)], "p double, n long"), table).collect()[0].pool == [4.0]
    hot = spark.range(5000).select(F.lit(1.0).alias("x"), F.col("id").cast("double").alias("v"), F.col("id").alias("__id"))
    pool = impute.donor_pools(hot, "x", "v").collect()
    assert len(pool) == 1 and len(set(pool[0].pool)) == impute.POOL


def test_values_come_from_donors_and_reruns_agree(df, rows):
    make = lambda: ForestImputer(nums=["a", "b", "d"], cats=["c"], method="mice_forest", rounds=1).fit(df)
    m = make()
    got = filled(m, df)
    seen = [{r[k] for r in rows} - {None} for k in (1, 2, 3)]
    assert all(r.a in seen[0] and r.b in seen[1] and r.c in seen[2] for r in got.values())
    assert len({got[r[0]].b for r in rows if r[2] is None}) > 10  # not one value for all
    assert filled(m, df) == got and filled(make(), df) == got


@pytest.mark.parametrize("method", ["miss_forest", "mice_forest"])
def test_saved_models_fill_alike(spark, df, rows, method, tmp_path):
    m = ForestImputer(nums=["a", "b", "d"], cats=["c"], method=method, rounds=1).fit(df)
    m.write().save(f"{tmp_path}/m")
    other = spark.newSession()
    back = ForestImputerModel.load(f"{tmp_path}/m")
    # a column that was complete at fit time has gaps now, and there is a category that was not seen
    new = other.createDataFrame([(1, 3.0, None, "lo", None), (2, None, None, None, 1.0), (3, float("nan"), None, "other", None)], SCHEMA)
    a, b = filled(m, new), filled(back, new)
    assert a == b and all(None not in (r.a, r.b, r.c, r.d) for r in a.values())
    assert a[3].c == "other" and back.changes == m.changes


def test_preparation_with_forests_is_saved(spark, df, tmp_path):
    pipe = data_preprocessing(df.select("b", "c"), imputation_numerical="miss_forest", imputation_categorical="miss_forest")
    df = df.select("b", "c")
    fitted = pipe.fit(df)
    fitted.write().save(f"{tmp_path}/p")
    want = [r.features for r in fitted.transform(df).collect()]
    assert [r.features for r in PipelineModel.load(f"{tmp_path}/p").transform(df).collect()] == want


def test_odd_tables(spark, df):
    empty = df.limit(0)
    m = ForestImputer(nums=["a"], cats=["c"]).fit(df.where("a IS NOT NULL AND c IS NOT NULL"))
    assert m.transform(empty).count() == 0
    none = spark.createDataFrame([(1, None, 2.0, None, 1.0), (2, None, 3.0, None, None)], SCHEMA)
    got = ForestImputer(nums=["a", "b", "d"], cats=["c"]).fit(none).transform(none).collect()
    assert all(r.a is None and r.c is None and r.d == 1.0 for r in got)
    assert ForestImputer(nums=[], cats=[]).fit(df).transform(df).count() == df.count()
    assert Pipeline(stages=[ForestImputer(nums=["b"], cats=[])]).fit(df).transform(df).where("b IS NULL").isEmpty()


def test_donor_stages_use_all_cores_and_score_only_gaps(spark, monkeypatch):
    from lakelens.operators import impute

    monkeypatch.setattr(impute, "FEW", 50)
    one_part = spark.range(400, numPartitions=1).select(
        (F.col("id") % 23).cast("double").alias("a"),
        F.when(F.col("id") % 5 != 0, (F.col("id") % 7).cast("double")).alias("b"),
        F.when(F.col("id") % 3 != 0, F.when(F.col("id") % 2 == 0, "x").otherwise("y")).alias("c"),
    )
    parts, scored = [], []
    learn, filled = impute._learn, impute.Stage._filled

    def learn_seen(df, *rest):
        parts.append(df.rdd.getNumPartitions())
        return learn(df, *rest)

    def filled_seen(self, df, *rest):
        scored.append((self.target, df.count(), df.where(~F.col(f"__na_{self.target}")).count()))
        return filled(self, df, *rest)

    monkeypatch.setattr(impute, "_learn", learn_seen)
    monkeypatch.setattr(impute.Stage, "_filled", filled_seen)
    out = ForestImputer(nums=["a", "b"], cats=["c"], method="mice_forest", rounds=1).fit(one_part).transform(one_part)
    assert min(parts) > 1
    assert sorted(set(scored)) == [("b", 80, 0), ("c", 134, 0)]
    assert out.count() == 400 and out.where("a IS NULL OR b IS NULL OR c IS NULL").count() == 0
