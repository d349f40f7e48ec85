"""Column roles, the single notion of "missing", and name helpers."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Roles(NamedTuple):
    num: list[str]
    cat: list[str]
    time: list[str]
    other: list[str]


def roles(df: DataFrame, columns: list[str] | None = None, override: dict[str, str] | None = None) -> Roles:
    """Split columns into numeric / categorical / time / other by their type.

    ``override`` maps a column to 'num', 'cat', 'time' or 'other' (label-like integers, for example).
    """
    out = Roles([], [], [], [])
    for f in df.schema.fields:
        if columns is not None and f.name not in columns:
            continue
        if override and f.name in override:
            getattr(out, override[f.name]).append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            out.num.append(f.name)
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            out.cat.append(f.name)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out.time.append(f.name)
        else:
            out.other.append(f.name)
    return out


def col(name: str) -> Column:
    """Column by exact name: dots and backticks in names are safe."""
    return F.col("`" + name.replace("`", "``") + "`")


def _fractional(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN for floating point columns."""
    c = col(name)
    return (c.isNull() | F.isnan(c)) if _fractional(df, name) else c.isNull()


def number(df: DataFrame, name: str) -> Column:
    """The column as double with NaN turned into NULL, so that aggregates skip it."""
    c = col(name)
    if _fractional(df, name):
        return F.when(~F.isnan(c), c.cast("double"))
    return c.cast("double")


def text(df: DataFrame, name: str) -> Column:
    """Categorical value as string; booleans read 'True' / 'False'."""
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.when(col(name), "True").when(~col(name), "False")
    return col(name).cast("string")


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """List-wise deletion over ``columns``."""
    return df.dropna(subset=columns) if columns else df


def infer_operation(df: DataFrame, target: str) -> str:
    return "regression" if isinstance(df.schema[target].dataType, T.NumericType) else "classification"


def clean_name(name: str) -> str:
    """Whitespace runs to '_', accents stripped, only alphanumerics and '_' kept."""
    joined = "_".join(name.split())
    plain = "".join(c for c in unicodedata.normalize("NFD", joined) if unicodedata.category(c) != "Mn")
    return re.sub(r"[^\w]", "", plain)


def clean_names(df: DataFrame) -> DataFrame:
    names = [clean_name(c) for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"column names collide after cleaning: {clash}")
    return df.toDF(*names)


def strip_prefix(df: DataFrame, *prefixes: str) -> DataFrame:
    renames = {}
    for c in df.columns:
        for p in prefixes:
            if c.startswith(p):
                renames[c] = c[len(p):]
                break
    return df.withColumnsRenamed(renames)


def r(c: Column, digits: int = 6) -> Column:
    """Rounded value without negative zero, for reports."""
    return F.round(c, digits) + F.lit(0.0)
