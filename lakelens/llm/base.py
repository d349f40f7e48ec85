"""Registry of this package's queries, and NumPy views of Arrow text."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.plans.session import checkpoint_root
from lakelens.sources.io import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


ARROW_BYTES = 8 << 20  # of a batch that goes to a Python worker


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session have at most ARROW_BYTES; a smaller bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub("[^0-9]", "", spark.conf.get(name))) > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def shared_path(spark: SparkSession) -> str:
    """A new folder in the shared folder of the cluster."""
    return f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) of all documents; a null text is empty."""
    return texts(table(spark, folder, "documents"))


def texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary column without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``most`` bytes; a longer row makes a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + l) over all pairs."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def packed(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list]:
    """(``names`` and one struct of all other columns, the columns that restore ``docs``): other columns clash with nothing."""
    rest = [c for c in docs.columns if c not in names]
    row = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(rest)]) if rest else F.lit(None).cast("int")
    back = [F.col(c) if c in names else F.col("__rest")[f"c{rest.index(c)}"].alias(c) for c in docs.columns]
    return docs.select(*[c for c in docs.columns if c in names], row.alias("__rest")), back
