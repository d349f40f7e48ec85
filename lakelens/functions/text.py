"""Cleaning of categorical values."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.functions.columns import col, roles, text


@F.pandas_udf(T.StringType())
def _without_accents(s: pd.Series) -> pd.Series:
    def plain(v):
        if v is None or v.isascii():
            return v
        return "".join(c for c in unicodedata.normalize("NFD", v) if not unicodedata.category(c) == "Mn")

    return s.map(plain, na_action="ignore")


def clean_text(c: Column) -> Column:
    """NFD without combining marks, then only letters, digits and '_' (spaces go too).

    Plain ASCII values (and values without letters beyond ASCII) take the same path; the accent step is
    the one part that built-in functions do not offer.
    """
    return F.regexp_replace(_without_accents(c), r"[^\p{L}\p{N}_]", "")


def clean_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Clean every categorical column. Columns with few distinct values still pass row by row in Arrow
    batches, so no value list is ever gathered."""
    for c in columns or roles(df).cat:
        df = df.withColumn(c, clean_text(text(df, c)))
    return df


def merged_values(df: DataFrame, column: str) -> DataFrame:
    """Cleaned values that stand for more than one original value."""
    raw = df.where(col(column).isNotNull()).groupBy(text(df, column).alias("value")).agg(F.count("*").alias("n"))
    return (
        raw.withColumn("cleaned", clean_text(F.col("value")))
        .groupBy("cleaned")
        .agg(F.count("*").alias("n_values"), F.sum("n").alias("n_rows"))
        .where("n_values > 1")
    )


def percent_text(c: Column) -> Column:
    return F.concat(F.format_string("%.1f", c), F.lit("%"))
