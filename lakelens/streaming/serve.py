"""Scoring of new rows with a saved pipeline, in batch or as a stream."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.functions.columns import col


def check_input(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """All model columns must be present; only the numeric ones are coerced to numbers."""
    missing = [c for c in numeric + categorical if c not in df.columns]
    if missing:
        raise ValueError(f"input lacks model columns: {missing}")
    text = [c for c in numeric if not isinstance(df.schema[c].dataType, T.NumericType)]
    return df.withColumns({c: col(c).cast("string").try_cast("double") for c in text}) if text else df


def score(model: PipelineModel, df: DataFrame, numeric: list[str], categorical: list[str], labels: list[str] | None = None) -> DataFrame:
    """Input rows plus ``prediction`` (decoded to ``predicted_label`` when labels are given)."""
    keep = df.columns
    out = model.transform(check_input(df, numeric, categorical))
    cols = [col(c) for c in keep] + [F.col("prediction")]
    if labels is not None:
        cols.append(F.get(F.array(*[F.lit(v) for v in labels]), F.col("prediction").cast("int")).alias("predicted_label"))
    return out.select(cols)


def score_stream(model: PipelineModel, stream: DataFrame, numeric: list[str], categorical: list[str], path: str, checkpoint: str, labels: list[str] | None = None):
    """Same scoring on a streaming DataFrame; scored rows are appended to Parquet exactly once."""
    scored = score(model, stream, numeric, categorical, labels)
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
