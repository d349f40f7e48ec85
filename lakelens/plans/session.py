"""Lineage cuts through the shared checkpoint folder, and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its row count, taken beforehand, is at most this.
BROADCAST_ROWS = 200_000
BROADCAST_NUMBERS = 1_000_000  # the same for tables of two or three plain numbers
BROADCAST_VECTORS = 20_000  # and for tables keyed by feature vectors

_local_root: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one in local mode only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_root:
        _local_root[sc.applicationId] = tempfile.mkdtemp(prefix="lakelens-")
    return _local_root[sc.applicationId]


def cut(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has a one-step lineage and survives the loss of executors. Unlike an RDD checkpoint the
    input is computed only once, and later scans prune columns. ``forget`` removes it.

    Scans pack files into tasks by their bytes on disk, and a file counts as a few MB at least: files of at most
    ``file_rows`` rows bound the rows of a task, for steps that hold a task's rows in another, larger form.
    """
    path = f"{checkpoint_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._cut_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Remove what ``cut`` wrote for ``frames``. Call it once their successors are written: nothing may read them any more."""
    for df in frames:
        path = getattr(df, "_cut_path", None)
        if path is not None:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            df._cut_path = None
            spark._jvm.System.gc()  # the driver's cleaner then drops the shuffle files of steps that are over


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of two frames on ``keys``."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of rows with a keyed table (unique, non-null ``key``) that stands hot keys.

    ``weight`` in ``table`` is the number of rows that carry the key. A table of at most ``limit`` rows is
    broadcast. Beyond that it is a shuffle join when no key holds more than 1/1000 of the rows; otherwise
    the hot keys (fewer than 1,000) are joined by broadcast, only the others are shuffled, and the result
    is written once so that chained lookups do not multiply scans.
    """
    table = table.persist()
    size, total, top = table.agg(F.count("*"), F.sum(weight), F.max(weight)).first()
    keep = [c for c in table.columns if c != weight]
    if size <= limit:
        return rows.join(F.broadcast(table.select(keep)), key)
    if top <= total / 1000:
        return rows.join(table.select(keep), key)
    hot = F.broadcast(table.where(F.col(weight) > total / 1000).select(keep))
    cold = table.where(F.col(weight) <= total / 1000).select(keep)
    return cut(rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key)))
