"""Registry of runnable queries with their SQL twins, and the shared input views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

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


def with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with NULLs put into l_tax and l_returnflag (the tables have none of their own)."""
    return table(spark, folder, "lineitem").withColumns(
        {
            "l_tax": F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax")),
            "l_returnflag": F.when(F.col("l_orderkey") % 11 != 0, F.col("l_returnflag")),
        }
    )


GAPS = """m AS (SELECT * REPLACE (CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS l_tax,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag) FROM lineitem)"""


def joined(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with its order and customer: the mixed-type table."""
    li, o, c = (table(spark, folder, t) for t in ("lineitem", "orders", "customer"))
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])


JOINED = """j AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

# Row identity of lineitem rows where a split needs one.
LINE_ID = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with class y, prediction p and score s in [0, 1), all derived from its rows."""
    li = table(spark, folder, "lineitem")
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    key = F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    noise = F.conv(F.substring(F.md5(key), 1, 3), 16, 10).cast("double") / 4096
    return (
        li.withColumn("y", y)
        .withColumn("p", F.when(F.col("l_orderkey") % 5 == 0, (F.col("y") + 1) % 3).otherwise(F.col("y")))
        .withColumn("b", (F.col("l_returnflag") == "R").cast("int"))
        .withColumn("s", noise * 0.75 + F.col("b") * 0.25)
        .withColumn("yhat", F.col("l_extendedprice") * (1 + ((F.col("l_partkey") % 21) - 10) / 100.0))
    )


PRED = """p0 AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS b,
  ('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber)), 1, 3))::INTEGER / 4096.0::DOUBLE AS noise FROM lineitem),
pred AS (SELECT *, CASE WHEN l_orderkey % 5 = 0 THEN (y + 1) % 3 ELSE y END AS p, noise * 0.75::DOUBLE + b * 0.25::DOUBLE AS s,
  l_extendedprice * (1 + ((l_partkey % 21) - 10) / 100.0::DOUBLE) AS yhat FROM p0)"""
