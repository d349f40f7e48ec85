"""Rolling data-quality facts of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.functions.columns import col, is_missing, number, roles


def with_event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP: zone-less times are read in the session time zone."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return df.withColumn(ts, col(ts).cast("timestamp"))
    return df


def window_facts(df: DataFrame, ts: str, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, n_rows, missing_cells, missing_pct, mean_<c>, min_<c>, max_<c>) per event-time window.

    On a stream the watermark closes windows (append mode emits closed windows only); on a batch the same
    plan gives every window.
    """
    cols = [c for c in df.columns if c != ts]
    nums = [c for c in roles(df).num]
    timed = with_event_time(df, ts)
    if timed.isStreaming:
        timed = timed.withWatermark(ts, late)
    miss = sum(is_missing(df, c).cast("int") for c in cols)
    aggs = [F.count("*").alias("n_rows"), F.sum(miss).alias("missing_cells")]
    for c in nums:
        aggs += [F.avg(number(df, c)).alias(f"mean_{c}"), F.min(number(df, c)).alias(f"min_{c}"), F.max(number(df, c)).alias(f"max_{c}")]
    out = timed.groupBy(F.window(col(ts), every).alias("w")).agg(*aggs)
    pct = 100.0 * F.col("missing_cells") / (F.col("n_rows") * len(cols))
    return out.select(F.col("w.start").alias("window_start"), "n_rows", "missing_cells", pct.alias("missing_pct"), *[f"{k}_{c}" for c in nums for k in ("mean", "min", "max")])


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Drive a windowed stream over everything that is available and stop."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_upserts(stream: DataFrame, path: str, checkpoint: str, key: str = "window_start") -> DataFrame:
    """The same in update mode: windows that are still open at the end count too.

    Each micro-batch overwrites a folder of its own, so a repeated batch changes nothing; the latest row of each key holds.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = stream.sparkSession.read.option("basePath", path).parquet(path)
    names = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "batch").alias("r")).select("r.*")
