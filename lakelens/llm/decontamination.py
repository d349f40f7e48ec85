"""Benchmark decontamination by winnowing: shared fingerprints find candidate windows, exact windows confirm them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.base import packed, query
from lakelens.plans.session import cut
from lakelens.sources.io import table

WINDOW = 10  # words
GRAM = 5  # words of a hashed k-gram; a window has WINDOW - GRAM + 1 of them
BROADCAST_PRINTS = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters and all characters beyond ASCII, after A-Z became lower case (null: none)."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK), lambda w: w != "")


def _at(array: Column, i: Column) -> Column:
    return F.get(array, i)


def grams(array: Column) -> Column:
    """Hash of the k-gram at each position."""
    n = F.size(array) - (GRAM - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[_at(array, i + k) for k in range(GRAM)]))).otherwise(F.array().cast("array<bigint>"))


def minima(hashes: Column) -> Column:
    """Smallest k-gram hash of each window: the window's fingerprint. Windows overlap, so few values are new."""
    n = F.size(hashes) - (WINDOW - GRAM)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least(*[_at(hashes, i + k) for k in range(WINDOW - GRAM + 1)]))).otherwise(F.array().cast("array<bigint>"))


def run_starts(prints: Column) -> Column:
    """Windows whose fingerprint differs from that of the window before."""
    n = F.size(prints)
    return F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (_at(prints, i) != _at(prints, i - 1)))).otherwise(F.array().cast("array<int>"))


def runs(prints: Column, starts: Column) -> Column:
    """(n, print, first, last) of the runs of windows with one fingerprint: what winnowing keeps."""
    last = lambda k: F.coalesce(_at(starts, k + 1), F.size(prints)) - 1
    return F.transform(starts, lambda s, k: F.struct(F.lit(WINDOW).alias("n"), _at(prints, s).alias("print"), s.alias("first"), last(k).alias("last")))


def short_prints(array: Column, n: int) -> Column:
    """The same for windows of ``n`` words, each with a fingerprint of its own."""
    count = F.size(array) - (n - 1)
    row = lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(F.concat_ws(" ", F.slice(array, i + 1, n))).alias("print"), i.alias("first"), i.alias("last"))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), row)).otherwise(F.array().cast("array<struct<n:int,print:bigint,first:int,last:int>>"))


def windows_of(items: DataFrame) -> DataFrame:
    """(n, words, print, item_id): the distinct windows of benchmark items; a short item is one window of its own length."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(WINDOW))
    cuts = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.slice("w", i + 1, n))
    rows = rows.select("item_id", n.alias("n"), F.explode(cuts).alias("words")).distinct()
    whole = F.least(*[F.xxhash64(*[F.get("words", F.lit(i + k)) for k in range(GRAM)]) for i in range(WINDOW - GRAM + 1)])
    return rows.select("item_id", "n", F.concat_ws(" ", "words").alias("window"), F.when(F.col("n") == WINDOW, whole).otherwise(F.xxhash64(F.concat_ws(" ", "words"))).alias("print"))


KEY = ["k1", "k2"]


def keyed(docs: DataFrame) -> DataFrame:
    """Adds a 128-bit key of (doc_id, text): rows with one key have one result."""
    return docs.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit("second"), "text", "doc_id")})


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(k1, k2, n_hit, items) of the documents in which windows of items occur; ``docs`` is keyed.

    Every window of 10 words has 6 k-grams of 5 words, and its smallest hash is its fingerprint. Equal
    windows have equal fingerprints, so each shared span of 10 words is found. Runs of windows with one
    fingerprint are one row (about 28 % of the words). They meet the benchmark's fingerprints in a join,
    and each window of a run that meets one is compared word by word: hits extend to all their words and
    hash collisions go. An item of fewer than 10 words is one window of its own length and is met by the hash of that window.
    Up to BROADCAST_PRINTS fingerprints (counted first) are broadcast and the words travel with the runs; beyond that
    the runs alone are shuffled and the words are joined again by key. Both ways give the same rows.
    """
    known = cut(windows_of(items))
    lengths = sorted(r[0] for r in known.where(F.col("n") < WINDOW).select("n").distinct().collect())  # at most 9
    prints = known.select("n", "print").distinct()
    worded = docs.select(*KEY, words(F.col("text")).alias("w"))
    steps = worded.withColumn("g", grams(F.col("w"))).withColumn("m", minima(F.col("g"))).withColumn("s", run_starts(F.col("m")))
    found = runs(F.col("m"), F.col("s"))
    rows = F.concat(found, *[short_prints(F.col("w"), n) for n in lengths]) if lengths else found
    if known.count() <= BROADCAST_PRINTS:
        met = steps.select(*KEY, "w", F.explode(rows).alias("r")).select(*KEY, "w", "r.*").join(F.broadcast(prints), ["n", "print"])
        windows = F.broadcast(known.select("n", "window", "item_id"))
    else:
        met = steps.select(*KEY, F.explode(rows).alias("r")).select(*KEY, "r.*").join(prints, ["n", "print"]).join(worded, KEY)
        windows = known.select("n", "window", "item_id")
    cut_out = F.transform(F.sequence("first", "last"), lambda i: F.struct(i.alias("start"), F.concat_ws(" ", F.slice("w", i + 1, F.col("n"))).alias("window")))
    met = met.select(*KEY, "n", F.explode(cut_out).alias("c")).select(*KEY, "n", "c.start", "c.window").join(windows, ["n", "window"])
    by_doc = met.groupBy(*KEY).agg(F.collect_set(F.struct("start", "n")).alias("hits"), F.collect_set("item_id").alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1))))
    return by_doc.select(*KEY, F.size(covered).cast("long").alias("n_hit"), F.array_sort("items").alias("items"))


WORDS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` with n_words, n_hit and items (ids of the items with occurring windows, sorted as strings).

    Null and empty texts have no words and no hits; null items have no windows; repeated rows each get
    their result, repeated item ids count once, null item ids are left out of ``items``. Columns of these
    names in ``docs`` are replaced.
    """
    docs = keyed(docs.drop("n_words", "n_hit", "items", *KEY))
    n = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    out = docs.withColumn("n_words", n).join(hits(docs, items), KEY, "left").drop(*KEY)
    return out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})


@query("op6_decontamination")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    rows = decontaminate(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: documents without any window of the benchmark."""
    rows, back = packed(docs, ("doc_id", "text"))
    return decontaminate(rows, table(spark, folder, "benchmark")).where("n_hit = 0").select(*back)
