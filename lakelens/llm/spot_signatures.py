"""Document fingerprints by spot signatures: content words that follow common-word anchors."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.llm.base import documents, query
from lakelens.plans.session import cut

# Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in a is it for with as was on be at by this that are or from an have not which "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es "
    "le la les et en un du une que est pour qui dans par plus pas au sur se "
    "el los del las por con no una su al lo y de"
).split()
CHAIN = 2
ROWS_PER_BUCKET = 2_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def with_signatures(df: DataFrame, text: str, out: str, anchors: list[str] | tuple[str, ...] = ANCHORS) -> DataFrame:
    """Adds ``out``: the distinct signatures of ``text`` as sorted 32-bit integers.

    A signature is an anchor with the next CHAIN words that are not anchors (fewer at the end of the
    text). Each anchor of a run of anchors makes one, and the start of the text is an anchor too. In a
    text without any listed word every word is an anchor of the words after it. No words: no signatures.
    """
    w, at = f"{out}_w", f"{out}_at"
    df = df.withColumn(w, words(F.col(text)))
    positions = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: ~F.get(F.col(w), i).isin(*anchors))
    df = df.withColumn(at, F.when(F.size(w) > 0, positions).otherwise(F.array().cast("array<int>")))
    word = lambda i: F.get(F.col(w), i)
    place = lambda k: F.get(F.col(at), k)
    bare = F.size(w) == F.size(at)

    def signed(p, k):
        # the anchors of this content word stand between the one before and it
        low = F.when(bare, p - 1).otherwise(F.coalesce(place(k - 1), F.lit(-2)) + 1)
        chain = [word(place(k + c)) for c in range(CHAIN)]
        one = lambda a: F.hash(F.coalesce(F.when(a >= 0, word(a)), F.lit("^")), *chain)
        return F.when(low < p, F.transform(F.sequence(low, p - 1), one)).otherwise(F.array().cast("array<int>"))

    return df.withColumn(out, F.array_sort(F.array_distinct(F.flatten(F.transform(F.col(at), signed))))).drop(w, at)


def fingerprint(signatures: Column) -> Column:
    """Eight hexadecimal digits of each signature, in order."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.hex(s.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 without comparing where the sizes alone rule out ``least``. Two empty sets are equal."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    exact = both / (F.size(a) + F.size(b) - both)
    return F.when(high == 0, 1.0).when(low < high * F.lit(least), 0.0).otherwise(exact).cast("double")


def with_next(docs: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(doc_id, text, bucket, h, guard), dealt by bucket: ranges of doc_id, each closed by a copy of the row that follows.

    Order: descending doc_id, nulls last, then text hash; after the last row the first. The guard rows (one
    or few for each bucket) let a window within each bucket see the next row, so no window spans the table and
    the text is shuffled once. The bounds are quantiles of doc_id: one number for each ``rows_per_bucket`` rows.
    """
    docs = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    n = docs.count()
    parts = max(1, math.ceil(n / rows_per_bucket))
    bounds = sorted(set(docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    spread = docs.withColumn("d", F.col("doc_id").cast("double"))
    if bounds:
        spread = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="d", outputCol="b", handleInvalid="keep").transform(spread)
    else:
        spread = spread.withColumn("b", F.lit(0.0))
    spread = spread.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("b").cast("int"))).select("doc_id", "text", "h", "bucket")
    # the first row of each bucket, in the order above, and the bucket that it closes: one row by bucket
    first = F.max(F.struct("doc_id", F.bitwise_not(F.col("h")).alias("m")))
    heads = spread.groupBy("bucket").agg(first.alias("f"))
    order = Window.orderBy(F.col("bucket").desc())
    before = F.coalesce(F.lag("bucket").over(order), F.min("bucket").over(Window.partitionBy()))
    heads = heads.select(F.col("bucket"), F.col("f.doc_id").alias("head_id"), F.bitwise_not(F.col("f.m")).alias("head_h"), before.alias("closes"))
    heads = spread.sparkSession.createDataFrame(heads.collect(), heads.schema)  # a row for each bucket
    cond = (spread["bucket"] == heads["bucket"]) & spread["doc_id"].eqNullSafe(heads["head_id"]) & (spread["h"] == heads["head_h"])
    joined = spread.join(F.broadcast(heads), cond, "left").select(spread["*"], "closes")
    places = F.array_compact(F.array(F.struct("bucket", F.lit(0).alias("guard")), F.when(F.col("closes").isNotNull(), F.struct(F.col("closes").alias("bucket"), F.lit(1).alias("guard")))))
    return joined.select("doc_id", "text", "h", F.explode(places).alias("p")).select("doc_id", "text", "h", "p.bucket", "p.guard").repartition("bucket")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, signatures, fingerprint) of whole texts; null texts are empty and have the empty fingerprint. Other columns are ignored."""
    rows = with_signatures(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "signatures")
    return rows.select("doc_id", "signatures", fingerprint(F.col("signatures")).alias("fingerprint"))


def near_pairs(prints: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs, membership): pairs (a, b, likeness) of different fingerprints at least ``least`` alike, and (doc_id, fingerprint, id).

    Documents with one fingerprint are one set, named by the hash of the fingerprint. Sets are partitioned by length so that
    partners lie in the same partition or in the next (sizes differ by the factor ``least`` at most). Within
    them a set meets others by its rarest signatures only: of n signatures any partner shares one of the
    rarest n - ceil(least * n) + 1, so frequent signatures are never joined. Empty sets have no pairs.
    """
    # written first: a filter on the signatures would otherwise be pushed into the scan and compute them for each word
    prints = cut(prints.select("doc_id", "signatures", "fingerprint")).withColumn("id", F.substring(F.sha2("fingerprint", 256), 1, 32))
    sets = cut(prints.select("id", "signatures").where(F.size("signatures") > 0).dropDuplicates(["id"]))
    counts = sets.select(F.explode("signatures").alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    ranked = sets.select("id", F.size("signatures").alias("size"), F.explode("signatures").alias("s")).join(counts, "s")
    ranked = ranked.groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("r"))
    keep = (F.col("size") - F.ceil(F.col("size") * F.lit(least) - 1e-9) + 1).cast("int")
    part = F.floor(F.log("size") / -math.log(least) + 1e-9).cast("int")
    index = cut(ranked.select("id", "size", part.alias("part"), F.explode(F.slice("r", F.lit(1), keep)).alias("p")).select("id", "size", "part", F.col("p.s").alias("s")))
    left = index.withColumn("meets", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    a, b = left.alias("a"), index.alias("b")
    near = (F.col("a.meets") == F.col("b.part")) & (F.col("a.s") == F.col("b.s")) & (F.col("a.size") >= F.col("b.size") * F.lit(least)) & (F.col("b.size") >= F.col("a.size") * F.lit(least))
    once = (F.col("a.part") < F.col("b.part")) | (F.col("a.id") < F.col("b.id"))
    found = a.join(b, near & once).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    found = found.join(sets.select(F.col("id").alias("a"), F.col("signatures").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("signatures").alias("sb")), "b")
    pairs = found.select("a", "b", likeness(F.col("sa"), F.col("sb"), least).alias("likeness")).where(F.col("likeness") >= least)
    return pairs, prints.select("doc_id", "fingerprint", "id")


@query("op3_spot_signatures")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_signatures(with_next(documents(spark, folder)), "text", "own")
    order = Window.partitionBy("bucket").orderBy("guard", F.col("doc_id").desc_nulls_last(), "h")
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "next": F.lead("own").over(order)}).where("guard = 0")
    n = F.length("text")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) AS int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 2) AS int))")))
    rows = with_signatures(rows, "edited", "other")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
