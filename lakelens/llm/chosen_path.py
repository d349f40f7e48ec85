"""Similarity join of documents on five-word shingles by chosen paths: split on sampled tokens, brute-force small buckets, repeat."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.base import bounded_batches, documents, packed, query, slices, utf8
from lakelens.llm.terms import mixed, word_bounds, word_hashes
from lakelens.operators.knn import connected_components
from lakelens.plans.session import cut, lookup

SHINGLE = 5  # words
LEAST = 0.8
TOKENS = 64  # sampled tokens (minima of random orders) of each set
RECALL = 0.999_999_8  # share of the pairs of similarity LEAST that the runs are to bring together
SLACK = 0.5  # share of equal sampled tokens below which a pair is not compared: 6 standard errors below LEAST
BUCKET = 512  # texts that are compared with each other in one task
DENSE = 0.5  # mean similarity to a pivot from which splitting a bucket gains nothing
DEPTH = 24

_MULTIPLY = mixed(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit shingles, distinct and ascending within each text; bounds).

    Words are runs of ASCII letters and digits, A-Z folded, and of all characters beyond ASCII. A text of one
    to four words is one shingle; a text without words has none.
    """
    part, edges = data[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0]
    starts, ends = word_bounds(part)
    seams = edges[1:-1]
    if len(starts) and len(seams):
        at = np.maximum(np.searchsorted(starts, seams, "right") - 1, 0)
        seams = np.unique(seams[(starts[at] < seams) & (ends[at] > seams)])
        starts, ends = np.sort(np.concatenate([starts, seams])), np.sort(np.concatenate([ends, seams]))
    (h,) = word_hashes(part, starts, ends)
    first = np.searchsorted(starts, edges)
    n = np.diff(first)
    width = np.repeat(np.minimum(n, SHINGLE), n)
    place = np.arange(len(h)) - np.repeat(first[:-1], n)
    keep = place <= np.repeat(n, n) - width
    padded = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    s = np.zeros(len(h), np.uint64)
    for k in range(SHINGLE):
        s = s * np.uint64(0xD6E8FEB86659FD93) + np.where(k < width, mixed(padded[k : k + len(h)] + np.uint64(k)), np.uint64(0))
    s, owner = mixed(s)[keep], np.repeat(np.arange(len(n)), n)[keep]
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[new], owner[new]
    return s, np.searchsorted(owner, np.arange(len(n) + 1))


def sampled_tokens(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """texts x TOKENS: for each of TOKENS random orders the first shingle of the set, as 32 bits; 0 for empty sets."""
    out = np.zeros((len(bounds) - 1, TOKENS), np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for t in range(TOKENS):
            order = s * _MULTIPLY[t]
            order ^= order >> np.uint64(32)
            out[full, t] = (np.minimum.reduceat(order * _MULTIPLY[-1 - t], bounds[full]) >> np.uint64(32)).astype(np.uint32)
    return out


def similar(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) of the pairs i < j with exact Jaccard similarity of at least ``least``."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), sizes)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = times[column] > 1
    owner, column = owner[use], (np.cumsum(times > 1) - 1)[column[use]]
    both = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    step = 4096
    for low in range(0, int((times > 1).sum()), step):
        a, b = np.searchsorted(column, [low, low + step])
        block = np.zeros((m, step), np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        both += block @ block.T
    i, j = np.triu_indices(m, 1)
    inter = both[i, j].astype(np.int64)
    union = sizes[i] + sizes[j] - inter
    near = (inter > 0) & (inter >= least * union - 1e-9)
    return i[near], j[near], inter[near] / np.maximum(union[near], 1)


def by_group(batches: Iterator[pa.RecordBatch], key: str = "bucket") -> Iterator[tuple[object, pa.Table]]:
    """(key, rows) of a partition that is sorted by ``key``."""
    held, at = [], None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(0, np.int64)
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[i] != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = keys[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield at, pa.Table.from_batches(held)


def _binary(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(b, kind) for b in column.to_pylist()]


def likely_members(batches):
    """The rows of each bucket that have a likely partner there, by their sampled tokens."""
    for key, rows in by_group(batches):
        sig = np.stack(_binary(rows["sig"], np.uint32))
        side = rows["side"].to_numpy()
        found = np.zeros(len(sig), bool)
        for i in range(0, len(sig), 64):
            equal = np.zeros((len(sig[i : i + 64]), len(sig)), np.int16)
            for t in range(TOKENS):
                equal += sig[i : i + 64, t, None] == sig[None, :, t]
            near = equal >= SLACK * TOKENS
            near[np.arange(len(near)), np.arange(i, i + len(near))] = False
            if (side > 0).any():  # two blocks of one bucket: pairs within a block have a group of their own
                near &= side[i : i + 64, None] != side[None, :]
            found |= near.any(0)
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(found.sum()), key)), pa.array(np.asarray(rows["t"].to_pylist(), object)[found], pa.string())], names=["bucket", "t"])


def links_of(batches):
    """Edges (a, b) that join what is connected by links within each bucket: fewer than its members."""
    for _, rows in by_group(batches):
        i, j, _ = similar(_binary(rows["shingles"], np.uint64), LEAST)
        if not len(i):
            continue
        root, edges = list(range(rows.num_rows)), []

        def find(x, root=root):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[b] = a
                edges.append((a, b))
        names = rows["t"].to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([names[a] for a, _ in edges]), pa.array([names[b] for _, b in edges])], names=["a", "b"])


def degrees(batches):
    """(t, texts, docs): links of each member within a group, to different texts and to their documents."""
    for _, rows in by_group(batches):
        i, j, _ = similar(_binary(rows["shingles"], np.uint64), LEAST)
        side, copies = rows["side"].to_numpy(), rows["copies"].to_numpy()
        if (side > 0).any():
            across = side[i] != side[j]
            i, j = i[across], j[across]
        n = rows.num_rows
        texts = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
        docs = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        yield pa.RecordBatch.from_arrays([rows["t"].combine_chunks(), pa.array(texts.astype(np.int64)), pa.array(docs.astype(np.int64))], names=["t", "texts", "docs"])


def grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def in_blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members (key, t, n) as groups of at most two blocks of about BUCKET texts: (bucket, t, side).

    ``sizes`` has (key, count, weight): a key of one block is one group; otherwise each pair of blocks is a
    group, and each block a group of its own. So no task holds a large key, whatever its size.
    """
    blocks = F.ceil(F.greatest(F.col("count") / BUCKET, F.col("n_all") / (BUCKET * 4096))).cast("int")
    rows = lookup(members, sizes.withColumn("blocks", blocks).select("key", "blocks", F.col("count").alias("weight")), "key", "weight")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("t", F.lit("block")), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    rows = rows.withColumn("p", F.explode(pair))
    side = F.when(F.col("p.i") == F.col("p.j"), 0).when(F.col("block") == F.col("p.i"), 1).otherwise(2)
    return rows.withColumns({"bucket": F.xxhash64("key", "p.i", "p.j"), "side": side}).drop("p", "block", "blocks")


def runs_for(recall: float, similarity: float = LEAST) -> int:
    """Runs that a pair of ``similarity`` needs: one run brings it together with that probability, all miss it with (1 - similarity) ** runs."""
    if not 0 < recall < 1:
        raise ValueError("recall must lie between 0 and 1")
    return min(TOKENS, max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity) - 1e-9)))


def expected_recall(runs: int, similarity: float) -> float:
    """Share of the pairs of a similarity that meet in a run and share enough sampled tokens to be compared."""
    need = math.ceil(SLACK * TOKENS)
    seen = sum(math.comb(TOKENS, k) * similarity**k * (1 - similarity) ** (TOKENS - k) for k in range(need, TOKENS + 1))
    return (1 - (1 - similarity) ** runs) * seen


def buckets_of(sets: DataFrame, runs: int) -> DataFrame:
    """(bucket, t, side): small groups that together hold each similar pair with high probability.

    ``sets`` has (t, n, sig). Each run starts with one sampled token: sets that share it are a bucket. A
    bucket of more than BUCKET sets is split again on two tokens chosen by the bucket's own hash, so a set
    follows two paths and a pair of similarity 0.8 stays together in one of them with 0.96. Where the sets
    of a large bucket are alike (mean similarity to a pivot of DENSE or more), splitting gains nothing, and the
    bucket is compared in pairs of blocks. Buckets with the same members are compared once.
    """
    token = lambda c: F.element_at("sig_a", c)
    rows = sets.select("t", "n", F.explode(F.array(*[F.xxhash64(F.lit(r), token(F.lit(r + 1))) for r in range(runs)])).alias("key"))
    small, large_parts = [], []
    for depth in range(DEPTH):
        rows = cut(rows)
        sizes = cut(rows.groupBy("key").agg(F.count("*").alias("count"), F.sum("n").alias("n_all")).where("count > 1"))
        small.append(lookup(rows, sizes.where(F.col("count") <= BUCKET).select("key", F.col("count").alias("weight")), "key", "weight"))
        big = sizes.where(F.col("count") > BUCKET)
        if big.isEmpty():
            break
        held = cut(lookup(rows, big.select("key", F.col("count").alias("weight")), "key", "weight").join(sets.select("t", "sig_a"), "t"))
        pivot = held.groupBy("key").agg(F.min_by("sig_a", F.xxhash64("t", "key")).alias("pivot"), F.count("*").alias("weight"))
        alike = F.size(F.filter(F.zip_with("sig_a", "pivot", lambda x, y: x == y), lambda x: x)) / TOKENS
        mean = lookup(held, pivot, "key", "weight").groupBy("key").agg(F.avg(alike).alias("mean"), F.count("*").alias("weight"))
        mean = cut(mean)
        dense = mean.where((F.col("mean") >= DENSE) | F.lit(depth + 1 == DEPTH))
        large_parts.append(in_blocks(lookup(held.drop("sig_a"), dense.select("key", "weight"), "key", "weight"), big).select("bucket", "t", "side"))
        sparse = mean.where((F.col("mean") < DENSE) & F.lit(depth + 1 < DEPTH))
        if sparse.isEmpty():
            break
        c = [(F.pmod(F.xxhash64("key", F.lit(b)), F.lit(TOKENS // 2)) * 2 + b + 1).cast("int") for b in (0, 1)]
        rows = lookup(held, sparse.select("key", "weight"), "key", "weight").select("t", "n", F.explode(F.array(*[F.xxhash64("key", x, token(x)) for x in c])).alias("key"))
    parts = small[0]
    for s in small[1:]:
        parts = parts.unionByName(s)
    # a bucket is known by its members; those of several runs are often the same
    members = F.array_sort(F.collect_list("t"))  # at most BUCKET
    unique = parts.groupBy("key").agg(members.alias("m")).groupBy(F.md5(F.array_join("m", "")).alias("id")).agg(F.first("m").alias("m"))
    out = unique.select(F.xxhash64("id").alias("bucket"), F.explode("m").alias("t"), F.lit(0).alias("side"))
    for p in large_parts:
        out = out.unionByName(p)
    return out


def classes(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, n_text_links, t, class_key) for every row of ``docs``.

    Two texts are linked if the Jaccard similarity of their shingle sets is at least 0.8; equal texts are always
    linked. A class is what links connect, named by its smallest doc_id. ``n_links`` counts the other
    documents that a document is linked with (rows, copies included), ``n_text_links`` the different texts. Texts
    without words, null ones included, are linked with equal texts only. Rows that repeat a doc_id
    are documents of their own; ``t`` is the MD5 of the text and ``class_key`` names the class also where ids are null. Candidates come from ``buckets_of``, in as many runs
    as ``recall`` of the pairs of similarity 0.8 needs (``runs_for``; ``expected_recall`` is the estimate with the
    comparison of sampled tokens, which misses 5e-9 of them). Links are exact, and within a class all are counted, block by block. Work grows with the square of the number of *different* texts only within
    classes and dense buckets; copies of a text are one set throughout.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = docs.select("doc_id", F.md5("text").alias("t"), "text")

    def sign(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for i, j in slices(offsets):
                s, bounds = shingle_sets(data, offsets[i : j + 1])
                sig = [r.tobytes() for r in sampled_tokens(s, bounds)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, j - i) for k in (0, 1)], pa.array(np.diff(bounds).astype(np.int64)), pa.array(sig, pa.binary())], names=["doc_id", "t", "n", "sig"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = cut(base.mapInArrow(sign, f"doc_id {kind}, t string, n long, sig binary"))
    counts = cut(rows.groupBy("t").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")))
    number = lambda k: F.conv(F.substring(F.hex("sig"), 8 * k + 1, 8), 16, 10).cast("long")
    sets = cut(rows.where("n > 0").dropDuplicates(["t"]).select("t", "n", "sig", F.array(*[number(k) for k in range(TOKENS)]).alias("sig_a")))
    groups = cut(buckets_of(sets, runs_for(recall)))
    likely = grouped(groups.join(sets.select("t", "sig"), "t")).mapInArrow(likely_members, "bucket long, t string")
    likely = cut(likely)

    def shingles(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                s, bounds = shingle_sets(data, offsets[i : j + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([s[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["t", "shingles"])

    # one document of each text in question brings its shingles
    wanted = likely.select("t").distinct().join(counts.select("t", "first_id"), "t")
    found = base.join(wanted.hint("merge"), (base["t"] == wanted["t"]) & base["doc_id"].eqNullSafe(wanted["first_id"])).select(base["t"], "text")
    full = cut(found.dropDuplicates(["t"]).mapInArrow(shingles, "t string, shingles binary"))
    edges = cut(grouped(likely.join(full, "t")).mapInArrow(links_of, "a string, b string"))
    comp = cut(connected_components(edges).select(F.col("node").alias("t"), F.col("component").alias("key")))
    members = comp.join(counts, "t").join(sets.select("t", "n"), "t")
    sizes = cut(members.groupBy("key").agg(F.count("*").alias("count"), F.sum("n").alias("n_all"), F.min("first_id").alias("class_id")))
    blocks = in_blocks(members.select("key", "t", "copies"), sizes.drop("class_id"))
    links = grouped(blocks.select("bucket", "t", "side", "copies").join(full, "t")).mapInArrow(degrees, "t string, texts long, docs long")
    links = links.groupBy("t").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    named = comp.join(sizes.select("key", "class_id"), "key").select("t", "key", "class_id")
    facts = counts.join(named, "t", "left").join(links, "t", "left")
    facts = facts.select(
        "t",
        F.coalesce("class_id", "first_id").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
        F.col("copies").alias("weight"),
        F.coalesce("key", "t").alias("class_key"),
    )
    return lookup(rows.select("doc_id", "t"), facts, "t", "weight", 0).select("doc_id", "class_id", "n_links", "n_text_links", "t", "class_key")


@query("op8_chosen_path")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return classes(documents(spark, folder)).drop("t", "class_key")


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: of each class one row stays, the one with the smallest doc_id (null last), then the smallest hash of its text.

    Null and empty texts are one text; they and texts without words are near equal texts only. Of rows that repeat id and
    text one stays. Texts of any length count whole, other columns may have any name, an empty table stays empty.
    """
    first = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "t")
    keep = classes(docs).groupBy("class_key").agg(F.min(first).alias("f")).select(F.col("f.doc_id").alias("kept_id"), F.col("f.t").alias("kept_t")).hint("merge")
    rows, back = packed(docs, ("doc_id", "text"))
    rows = rows.withColumn("__t", F.md5(F.coalesce("text", F.lit(""))))
    rows = rows.join(keep, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("__t") == F.col("kept_t")), "left_semi")
    return rows.dropDuplicates(["doc_id", "__t"]).select(*back)
