"""Mixing sources to target weights by hash thresholds: nested budgets, no sorting of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.llm.base import packed, query
from lakelens.plans.session import cut, lookup
from lakelens.sources.io import table

WEIGHTS = (3, 1, 2)
BITS = 12  # of each level of the histogram
LEVELS = 5  # 60 bits: then a bucket is one hash value


def measured(docs: DataFrame) -> DataFrame:
    """Adds ``size``, the number of runs of characters that are not ASCII white space (null: 0)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` times the whole
    size. A target stops at ``cap`` times its source's size and the excess is shared again by weight. The
    final level t, with target = min(cap * size, t * weight), is found from the sources in the order of
    cap * size / weight: t is fixed where what remains fits the sources that are not yet full.
    """
    # one row per source: the only unpartitioned windows
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights)).cast("int") + 1)
    rows = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    full = Window.orderBy(F.col("most") / F.col("w"), "place").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.col("most") / F.col("w"), "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("most").over(full), F.lit(0.0))) / F.sum("w").over(rest)
    rows = rows.withColumn("total", total).withColumn("level", level)
    # the first source, in this order, that the level does not fill, fixes the level of all after it
    open_at = F.when(F.col("level") * F.col("w") < F.col("most"), F.struct(F.row_number().over(Window.orderBy(F.col("most") / F.col("w"), "place")), F.col("level").alias("t")))
    rows = rows.withColumn("open", open_at).withColumn("t", F.min("open").over(Window.partitionBy())["t"])
    target = F.least("most", F.coalesce(F.col("t") * F.col("w"), F.col("most")))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Documents with size, source_size, target and copies.

    ``copies`` is how often the mix takes a document: the whole part of target / source_size, and once more
    if the document's hash lies below the source's threshold. Thresholds are nested: a larger target
    takes every document that a smaller one takes. They are found by histograms of hash prefixes: sum sizes by
    source and bucket, keep the buckets below the budget, and refine only the boundary bucket, to single hash values.
    Of the rows that share the boundary value (rows that repeat an id and text) as many are taken as come nearest to the
    budget (``first_rows``). The hash is of (doc_id, text) and does not depend on partitions, so reruns agree: which of several
    equal rows are taken may differ, how many not. An empty text has size 0 and may be taken or not. No document is sorted;
    a hot source is pre-aggregated in each task. Null sources are a source of their own, null texts are empty, texts
    are measured whole, and an empty table gives no rows. Columns of ``docs`` named size, source_size, target, copies, key, h,
    whole, threshold, divided, take, chosen, place, part or before are replaced.
    """
    reserved = {"size", "source_size", "target", "copies", "key", "h", "whole", "threshold", "divided", "take", "chosen", "place", "part", "before"}
    docs = measured(docs.drop(*[c for c in docs.columns if c.lower() in reserved]))
    docs = docs.withColumns({"key": source_key(), "h": F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - BITS * LEVELS)})
    slim = cut(docs.select("source", "key", "h", "size"))
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("weight"))
    plan = targets(totals, weights, share, cap).withColumn("key", source_key())
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(ratio)).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = cut(plan.join(totals.select(source_key().alias("key"), "weight"), "key"))
    # hashes below `low` are taken; [low, low + width) is the boundary bucket, of `docs` rows and `edge` words, and `left` its budget
    state = plan.select("key", "weight", F.lit(0).cast("long").alias("low"), F.lit(1 << BITS * LEVELS).alias("width"), "left", F.col("source_size").alias("edge"), F.col("weight").alias("docs"))
    for step in range(LEVELS):
        below = BITS * (LEVELS - 1 - step)
        active = state.where("docs > 1")
        inside = lookup(slim, active.select("key", "low", "left", "weight"), "key", "weight")
        inside = inside.where(F.shiftright("h", below + BITS) == F.shiftright("low", below + BITS))
        bucket = F.shiftright("h", below).bitwiseAND((1 << BITS) - 1)
        sums = inside.groupBy("key", "left", bucket.alias("bucket")).agg(F.sum("size").alias("edge"), F.count("*").alias("docs"))
        upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most 4,096 rows
        sums = sums.withColumn("upto", F.sum("edge").over(upto)).where(F.col("upto") > F.col("left"))
        found = sums.groupBy("key").agg(F.min_by(F.struct("bucket", "edge", "docs", "upto"), "bucket").alias("e"))
        new = active.drop("edge", "docs", "width").join(found, "key", "left")
        inner = new.where("e IS NOT NULL").select(
            "key",
            "weight",
            (F.col("low") + F.col("e.bucket") * F.lit(1 << below)).alias("low"),
            F.lit(1 << below).alias("width"),
            (F.col("left") - (F.col("e.upto") - F.col("e.edge"))).alias("left"),
            F.col("e.edge").alias("edge"),
            F.col("e.docs").alias("docs"),
        )
        # a budget that covers its whole bucket takes all of it
        covered = new.where("e IS NULL").select("key", "weight", "low", F.lit(1 << below + BITS).alias("width"), "left", F.lit(0).cast("long").alias("edge"), F.lit(0).cast("long").alias("docs"))
        state = cut(state.where("docs <= 1").unionByName(inner).unionByName(covered))
        if state.where("docs > 1").isEmpty():
            break
    # of the rows of a boundary value as many are taken as come nearest to the budget
    nearest = F.least("docs", F.floor(F.col("left") * F.col("docs") / F.col("edge") + 0.5))
    take = F.when(F.col("edge") > 0, nearest).otherwise(F.col("docs"))  # a lone row without words has no size to divide by
    threshold = F.col("low") + F.when(F.col("take") >= F.col("docs"), F.col("width")).otherwise(0)
    state = state.withColumn("take", take).select("key", threshold.alias("threshold"), F.when((F.col("take") > 0) & (F.col("take") < F.col("docs")), F.col("low")).alias("divided"), "take")
    plan = cut(plan.join(state, "key"))
    rows = lookup(docs, plan.select("key", "source_size", "target", "whole", "threshold", "divided", "take", "weight"), "key", "weight")
    is_divided = F.coalesce(F.col("h") == F.col("divided"), F.lit(False))
    chosen = rows.where(~is_divided).withColumn("chosen", F.col("h") < F.col("threshold"))
    if not plan.where("divided IS NOT NULL").isEmpty():
        chosen = chosen.unionByName(first_rows(rows.where(is_divided)))
    return chosen.withColumn("copies", F.col("whole") + F.col("chosen").cast("long")).drop("key", "h", "whole", "threshold", "divided", "take", "chosen")


def first_rows(rows: DataFrame) -> DataFrame:
    """Adds ``chosen`` to rows that share a hash within their source (key): ``take`` of them, whichever come first.

    They are written with their place; the numbers of rows by task and source are summed, so the rows of one source, however
    many, are counted by many tasks.
    """
    rows = cut(rows.withColumn("place", F.monotonically_increasing_id())).withColumn("part", F.shiftright("place", 33))
    sizes = rows.groupBy("key", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n")  # one row by task and source
    rows = rows.join(sizes.select("key", "part", before.alias("before")), ["key", "part"])
    number = F.row_number().over(Window.partitionBy("key", "part").orderBy("place")) + F.col("before")
    return rows.withColumn("chosen", number <= F.col("take")).drop("place", "part", "before")


def source_key():
    """A non-null key of a source."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))


@query("op7_mixing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    rows = mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it."""
    rows, back = packed(docs, ("doc_id", "text", "source"))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return mix(rows).where("copies > 0").select("*", copy).select(*back)
