"""Readers and writers: inferred CSV, Parquet, result tables, fitted pipelines."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.functions.columns import col

# The text forms accepted as date or timestamp.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "dd/MM/yyyy",
    "MM/dd/yyyy",
)


def _as_time(name: str, formats):
    return F.coalesce(*[F.try_to_timestamp(F.trim(col(name)), F.lit(f)) for f in formats])


def infer_timestamps(df: DataFrame, formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """Turn a string column into a timestamp iff every non-null value parses (one scan for all columns)."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    aggs = []
    for i, c in enumerate(names):
        aggs += [F.count(col(c)).alias(f"n{i}"), F.count(_as_time(c, formats)).alias(f"p{i}")]
    row = df.agg(*aggs).first()
    hits = {c for i, c in enumerate(names) if row[f"n{i}"] > 0 and row[f"n{i}"] == row[f"p{i}"]}
    return df.select([_as_time(c, formats).alias(c) if c in hits else col(c).alias(c) for c in df.columns])


def narrow_numbers(df: DataFrame) -> DataFrame:
    """double -> float and long -> int where every value fits (integers are range-checked first)."""
    longs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.LongType)]
    fits = set()
    if longs:
        row = df.agg(*[F.struct(F.min(col(c)), F.max(col(c))).alias(f"m{i}") for i, c in enumerate(longs)]).first()
        for i, c in enumerate(longs):
            lo, hi = row[f"m{i}"]
            if lo is None or (-(2**31) <= lo and hi < 2**31):
                fits.add(c)
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            c = c.cast("float")
        elif f.name in fits:
            c = c.cast("int")
        out.append(c.alias(f.name))
    return df.select(out)


def read_csv(spark: SparkSession, path: str, narrow: bool = False, schema: T.StructType | None = None, **options) -> DataFrame:
    """CSV with a header line. Pass ``schema`` at scale: inference costs one more scan."""
    reader = spark.read.options(header=True, **options)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    df = infer_timestamps(df)
    return narrow_numbers(df) if narrow else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Whole table or result table to CSV (header, no index column) or Parquet."""
    if fmt == "csv":
        flat = [
            F.to_json(col(f.name)).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else col(f.name).alias(f.name)
            for f in df.schema.fields
        ]
        df.select(flat).write.mode(mode).option("header", True).csv(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError("fmt must be csv or parquet")


def write_results(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One folder per result table (scores, associations, attributions, ...)."""
    for name, df in tables.items():
        write_table(df, f"{path}/{name}", fmt)


def save_pipeline(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
