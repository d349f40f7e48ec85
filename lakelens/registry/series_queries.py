"""Time series, batch and stream scoring, windowed facts."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F


from lakelens.operators import cv, series
from lakelens.operators.models import classifiers
from lakelens.plans.session import checkpoint_root
from lakelens.registry.base import query
from lakelens.sources.io import load_pipeline, save_pipeline, table
from lakelens.streaming import serve, windows

_DAYS = """d0 AS (SELECT event_type, date_trunc('day', ts) AS ts, sum(value) AS value FROM events GROUP BY 1, 2),
g AS (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM d0 GROUP BY 1),
days AS (SELECT g.event_type, g.ts, coalesce(value, 0) AS value FROM g LEFT JOIN d0 USING (event_type, ts))"""


def daily(spark, d):
    return series.resample(table(spark, d, "events"), "ts", "value", "1 day", ["event_type"])


@query("h4_resample_daily", f"WITH {_DAYS} SELECT event_type, ts, round(value, 4) AS value FROM days")
def _(spark, d):
    return daily(spark, d).withColumn("value", F.round("value", 4))


@query(
    "h4_resample_hourly",
    """WITH h AS (SELECT date_trunc('hour', ts) AS ts, sum(value) AS value FROM events GROUP BY 1), g AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM h)
SELECT ts, round(coalesce(value, 0), 4) AS value FROM g LEFT JOIN h USING (ts)""",
)
def _(spark, d):
    return series.resample(table(spark, d, "events"), "ts", "value", "1 hour").withColumn("value", F.round("value", 4))


def _decompose_sql(source, key, period):
    half = period // 2
    part = f"PARTITION BY {key}" if key else ""
    by = f"{key}, " if key else ""
    wide = f"sum(value) OVER ({part} ORDER BY ts ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    inner = f"sum(value) OVER ({part} ORDER BY ts ROWS BETWEEN {half - 1} PRECEDING AND {half - 1} FOLLOWING)"
    total = wide if period % 2 else f"({wide} + {inner}) / 2"
    return f"""t AS (SELECT {by}ts, value, CASE WHEN count(*) OVER ({part} ORDER BY ts ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) = {2 * half + 1} THEN {total} / {period} END AS trend,
 (row_number() OVER ({part} ORDER BY ts) - 1) % {period} AS ph FROM {source}),
ph AS (SELECT {by}ph, avg(value / trend) AS m FROM t GROUP BY {by}ph), nm AS (SELECT *, m / avg(m) OVER ({part}) AS seasonal FROM ph)
SELECT {by}ts, round(value, 4) AS observed, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(value / trend / seasonal, 6) AS resid FROM t JOIN nm USING ({by}ph)"""


def _rounded(df):
    return df.withColumns({"observed": F.round("observed", 4), "trend": F.round("trend", 6), "seasonal": F.round("seasonal", 6), "resid": F.round("resid", 6)})


@query("h1_decompose_weekly", f"WITH {_DAYS}, {_decompose_sql('days', 'event_type', 7)}")
def _(spark, d):
    return _rounded(series.decompose(daily(spark, d), "ts", "value", 7, ["event_type"]))


@query(
    "h1_decompose_hourly",
    """WITH h AS (SELECT date_trunc('hour', ts) AS ts, sum(value) AS value FROM events GROUP BY 1), g AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM h),
hs AS (SELECT ts, coalesce(value, 0) AS value FROM g LEFT JOIN h USING (ts)), """
    + _decompose_sql("hs", "", 24),
)
def _(spark, d):
    hourly = series.resample(table(spark, d, "events"), "ts", "value", "1 hour")
    return _rounded(series.decompose(hourly, "ts", "value", 24, block=100))


@query("h2_kpss")
def _(spark, d):
    return series.kpss(daily(spark, d), "ts", "value", ["event_type"])


@query("h3_adf")
def _(spark, d):
    return series.adf(daily(spark, d), "ts", "value", ["event_type"])


# ---------------------------------------------------------------- serving

NUM, CAT = ["value", "user_id"], []


def event_rows(df):
    return df.select("event_id", "event_type", "value", "user_id", F.when(F.col("value") > 50, "high").otherwise("low").alias("level"))


def fitted(spark, d):
    """Preparation and model as one saved and reloaded pipeline, with the class labels."""
    rows = event_rows(table(spark, d, "events"))
    work, _, levels = cv.prepare_target(rows, "level")
    pre = cv.fit_preparation(work, NUM, {})
    model = classifiers(1000, 2, True, 2)["LogisticRegression"].build().fit(cv.transform_rows(pre, work).select("features", "label"))
    path = f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"
    save_pipeline(PipelineModel([*pre.stages, model]), path)
    return load_pipeline(path), levels.learned()["level"]


@query("z1_batch_scoring")
def _(spark, d):
    model, labels = fitted(spark, d)
    new = table(spark, d, "events").select("event_id", F.col("value").cast("string").alias("value"), "user_id")
    return serve.score(model, new, NUM, CAT, labels).select("event_id", "prediction", "predicted_label")


@query("s7_saved_pipeline")
def _(spark, d):
    model, labels = fitted(spark, d)
    return serve.score(model, table(spark, d, "events"), NUM, CAT, labels).groupBy("predicted_label").agg(F.count("*").alias("n"))


def stream_of(spark, d, name):
    """The table as a file stream (a single file or a folder of that name)."""
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


@query("z2_stream_scoring")
def _(spark, d):
    model, labels = fitted(spark, d)
    root = f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"
    q = serve.score_stream(model, stream_of(spark, d, "events").select("event_id", "value", "user_id"), NUM, CAT, f"{root}/rows", f"{root}/state", labels)
    q.awaitTermination()
    return spark.read.parquet(f"{root}/rows").select("event_id", "prediction", "predicted_label")


_FACTS = """SELECT date_trunc('day', ts) AS window_start, count(*) AS n_rows, count(*) FILTER (value % 2 < 0.5) AS missing_cells,
 round(100.0::DOUBLE * count(*) FILTER (value % 2 < 0.5) / (count(*) * 3), 6) AS missing_pct, round(avg(event_id), 4) AS mean_event_id, round(avg(CASE WHEN NOT (value % 2 < 0.5) THEN value END), 6) AS mean_value
 FROM events GROUP BY 1"""


def _gappy(df):
    return df.select("event_id", "ts", "event_type", F.when(~(F.col("value") % 2 < 0.5), F.col("value")).alias("value"))


def _facts(df):
    return df.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n_rows", F.col("missing_cells").cast("long").alias("missing_cells"),
        F.round("missing_pct", 6).alias("missing_pct"), F.round("mean_event_id", 4).alias("mean_event_id"), F.round("mean_value", 6).alias("mean_value"),
    )


@query("z3_windowed_profile_batch", _FACTS)
def _(spark, d):
    return _facts(windows.window_facts(_gappy(table(spark, d, "events")), "ts"))


@query("z3_windowed_profile_stream", _FACTS)
def _(spark, d):
    root = f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"
    return _facts(windows.run_upserts(windows.window_facts(_gappy(stream_of(spark, d, "events")), "ts"), f"{root}/rows", f"{root}/state"))
