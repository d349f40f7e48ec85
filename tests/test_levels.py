"""Level tables of any length, and saved models that own tables."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lakelens.operators import models, prep
from lakelens.operators.prep import RARE, Levels, LevelsModel, OneHot

N = 20_000


@pytest.fixture(scope="module")
def df(spark):
    """Half of the rows hold one value, a quarter another, and 20,000 values are there once or more."""
    hot = spark.range(40_000).select(F.lit("hot").alias("c"))
    warm = spark.range(25_000).select(F.lit("warm").alias("c"))
    rare = spark.range(N + 500).select(F.format_string("v%05d", (F.col("id") * 7919) % N).alias("c"))
    return hot.union(warm).union(rare).withColumn("id", F.monotonically_increasing_id())


def new_rows(spark):
    rows = [(1, "hot"), (2, "warm"), (3, "v00000"), (4, "v19999"), (5, "never seen"), (6, None), (7, "v00000")]
    return spark.createDataFrame(rows, "id long, c string")


@pytest.mark.parametrize("broadcast", [200_000, 100])
def test_rare_is_told_from_unknown(spark, df, broadcast, monkeypatch, tmp_path):
    monkeypatch.setattr(prep, "BROADCAST_ROWS", broadcast)
    fitted = Pipeline(stages=[OneHot(inputCols=["c"])]).fit(df)
    assert fitted.stages[0].output_names() == ["c_hot", "c_warm", f"c_{RARE}"]
    fitted.write().save(f"{tmp_path}/p")
    want = {1: (1, 0, 0), 2: (0, 1, 0), 3: (0, 0, 1), 4: (0, 0, 1), 5: (0, 0, 0), 6: (0, 0, 0), 7: (0, 0, 1)}
    for m in (fitted, PipelineModel.load(f"{tmp_path}/p")):
        out = m.transform(new_rows(spark))
        assert out.columns == ["id", "c", "c_hot", "c_warm", f"c_{RARE}"]
        assert {r[0]: tuple(map(int, r[2:])) for r in out.collect()} == want
    total = fitted.transform(df).agg(F.count("*"), F.sum("c_hot"), F.sum("c_warm"), F.sum(f"c_{RARE}")).first()
    assert tuple(map(int, total)) == (40_000 + 25_000 + N + 500, 40_000, 25_000, N + 500)


@pytest.mark.parametrize("broadcast", [200_000, 100])
def test_label_codes_of_many_labels(spark, df, broadcast, monkeypatch, tmp_path):
    monkeypatch.setattr(prep, "BROADCAST_ROWS", broadcast)
    m = Levels(inputCols=["c"]).fit(df)
    m.write().save(f"{tmp_path}/m")
    order = sorted({f"v{i:05d}" for i in range(N)} | {"hot", "warm"})
    for model in (m, LevelsModel.load(f"{tmp_path}/m")):
        out = model.decode(model.transform(new_rows(spark)), "c", "c_code", "back").collect()
        assert {r.id: (r.c_code, r.back) for r in out} == {r.id: ((order.index(r.c), r.c) if r.c in order else (None, None)) for r in out}
        assert len(out) == 7
    codes = m.transform(df).groupBy("c").agg(F.min("c_code").alias("a"), F.max("c_code").alias("b")).collect()
    assert {r.c: (r.a, r.b) for r in codes} == {v: (i, i) for i, v in enumerate(order)}


def test_short_lists_and_empty_columns(spark, tmp_path):
    few = spark.createDataFrame([("b", None), ("a", None), ("b", None), (None, None)], "x string, y string")
    m = Levels(inputCols=["x", "y"]).fit(few)
    assert m.learned() == {"x": ["a", "b"], "y": []} and not m.tables
    assert sorted((r.x_code for r in m.transform(few).collect()), key=str) == [0, 1, 1, None]
    hot = OneHot(inputCols=["x", "y"]).fit(few)
    assert hot.output_names() == ["x_b"] and hot.transform(few.limit(0)).count() == 0


def test_saved_neighbours_answer_alike(spark, tmp_path):
    rows = [([float(i % 5), float(i // 5)], float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "v array<double>, label double").select(array_to_vector("v").alias("features"), "label")
    df = df.union(df.limit(1)).union(df.limit(1))
    for task in ("classification", "regression"):
        m = models.KNeighbours(k=3, task=task).fit(df)
        Pipeline(stages=[]).fit(df)
        PipelineModel([m]).write().save(f"{tmp_path}/{task}")
        back = PipelineModel.load(f"{tmp_path}/{task}")
        got, want = (sorted((tuple(r.features), r.prediction) for r in x.transform(df).collect()) for x in (back, m))
        assert got == want and len(got) == 62
