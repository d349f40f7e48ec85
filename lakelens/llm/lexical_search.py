"""Ranked lexical search by pipelined term partitions: bundles of items visit the owners of their terms, one after the other."""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.llm.base import bounded_batches, query, slices, utf8
from lakelens.plans.session import cut, lookup
from lakelens.sources.io import table

TOP = 10
STAGES = 4  # owners of terms, from rare to frequent
BLOCK_BITS = 11  # documents of a bundle, as a power of two
ITEMS, ITEM_BYTES = 512, 4 << 20  # items and bytes of items that are searched together
MOST = 1_000_000  # no term adds more than this times its weight

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8: runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are folded."""
    return _WORD.findall(text.translate(_FOLD))


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of whole texts: number of all terms, and the terms of ``vocabulary`` with their occurrences."""
    size = max(1, len(vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        number = shared.value.get
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                found = [words(data[offsets[k] : offsets[k + 1]].tobytes()) for k in range(i, j)]
                n = np.array([len(f) for f in found], np.int64)
                ids = [np.fromiter(map(number, f, repeat(-1)), np.int64, len(f)) + k * size for k, f in enumerate(found)]
                flat = np.concatenate(ids)
                keys, times = np.unique(flat[flat >= np.repeat(np.arange(j - i) * size, n)], return_counts=True)
                ends = pa.array(np.searchsorted(keys, np.arange(j - i + 1) * size), pa.int32())
                columns = [pa.array(n), *[pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (keys % size, times)]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=["doc_id", "n", "terms", "tfs"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


def owned(counted: DataFrame, stage_of: np.ndarray, n_docs: int, n_words: int) -> DataFrame:
    """(b, at, doc_id, t0, c0, t1, c1, ...): the terms of each document by owner, with what an occurrence adds for each unit of weight."""
    stages = range(STAGES)

    def split(batches):
        for batch in batches:
            lists = batch.column("terms")
            first, last = lists.offsets[0].as_py(), lists.offsets[-1].as_py()
            terms = lists.values.slice(first, last - first).to_numpy()
            tf = batch.column("tfs").values.slice(batch.column("tfs").offsets[0].as_py(), last - first).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            m = 25 + 75 * batch.column("n").to_numpy() * n_docs // n_words
            gain = 1_000_000_000 * tf // (1000 * tf + 8 * m[row])
            own, out = stage_of[terms], []
            for s in stages:
                pick = own == s
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[pick], minlength=batch.num_rows))]), pa.int32())
                out += [pa.ListArray.from_arrays(ends, pa.array(x[pick].astype(np.int32))) for x in (terms, gain)]
            names = ["b", "at", "doc_id", *[f"{c}{s}" for s in stages for c in "tc"]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("b", "at", "doc_id")], *out], names=names)

    schema = "b long, at int, doc_id long, " + ", ".join(f"t{s} array<int>, c{s} array<int>" for s in stages)
    return counted.select("b", "at", "doc_id", "n", "terms", "tfs").mapInArrow(split, schema)


BUNDLE = "b long, item array<int>, at array<int>, score array<long>"


def visit(stage: int, items: tuple[np.ndarray, np.ndarray, np.ndarray], rest: np.ndarray, n_items: int):
    """A bundle (the accumulators of all items over one block of documents) at the owner of ``stage``.

    ``items`` are (item, term, weight times repeats) of this owner's terms, ``rest`` bounds what later owners can
    add to each item. Every contribution is added as an integer. Accumulators that cannot reach the TOP-th score of
    their item within the block any more are left behind; the last owner hands out the TOP best of each item.
    """
    item_of, term_of, weight_of = items
    last = stage == STAGES - 1

    def merge(bundle: pa.Table, docs: pa.Table) -> pa.Table:
        size = 1 << BLOCK_BITS
        scores = np.zeros((n_items, size), np.int64)
        for r in range(bundle.num_rows):
            item, at, score = (bundle[c][r].values.to_numpy() for c in ("item", "at", "score"))
            scores[item, at] = score
        docs = docs.combine_chunks()
        if docs.num_rows:
            flat = {c: pa.concat_arrays([x.flatten() for x in docs[c].chunks]).to_numpy() for c in ("t", "c")}
            lengths = np.concatenate([np.diff(x.offsets.to_numpy()) for x in docs["t"].chunks])
            place = np.repeat(docs["at"].to_numpy(), lengths)
            order = np.argsort(flat["t"], kind="stable")
            terms, gains, place = flat["t"][order], flat["c"][order].astype(np.int64), place[order]
            low, high = np.searchsorted(terms, term_of), np.searchsorted(terms, term_of, "right")
            for k in np.flatnonzero(high > low):
                own = slice(low[k], high[k])
                scores[item_of[k], place[own]] += weight_of[k] * gains[own]
        least = np.partition(scores, size - TOP, axis=1)[:, size - TOP]
        if not last:
            item, at = np.nonzero((scores > 0) & (scores + rest[:, None] >= least[:, None]))
            lists = [pa.array([x], pa.list_(kind)) for x, kind in ((item, pa.int32()), (at, pa.int32()), (scores[item, at], pa.int64()))]
            key = (bundle if bundle.num_rows else docs)["b"][0].as_py()
            return pa.Table.from_arrays([pa.array([key], pa.int64()), *lists], names=["b", "item", "at", "score"])
        item, at = np.nonzero((scores > 0) & (scores >= least[:, None]))
        null, ids = np.ones(size, bool), np.zeros(size, np.int64)
        column = docs["doc_id"]
        null[docs["at"].to_numpy()] = column.is_null().to_numpy()
        ids[docs["at"].to_numpy()] = column.fill_null(0).to_numpy()
        order = np.lexsort((ids[at], null[at], -scores[item, at], item))
        item, at = item[order], at[order]
        first = np.searchsorted(item, np.arange(n_items))
        keep = np.arange(len(item)) - first[item] < TOP
        item, at = item[keep], at[keep]
        found = pa.array(ids[at], pa.int64(), mask=null[at])
        return pa.Table.from_arrays([pa.array(item, pa.int32()), found, pa.array(scores[item, at], pa.int64())], names=["item", "doc_id", "score"])

    return merge


def weights(counted: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, w) of the terms that occur."""
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("w", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long"))


def search_block(docs: DataFrame, texts: list[str]) -> DataFrame:
    """(item, rank, doc_id, score) of some items, known by their place in ``texts``."""
    found = [words(t.encode()) for t in texts]
    vocabulary = {w: i for i, w in enumerate(sorted({w for f in found for w in f}))}
    counted = postings(docs, vocabulary).withColumn("r", F.monotonically_increasing_id())
    counted = cut(counted.where("n > 0")).withColumns({"b": F.shiftright("r", BLOCK_BITS), "at": F.col("r").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")})
    n_docs, n_words = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    known = sorted(((r.w, r.df, r.term) for r in weights(counted, n_docs).collect() if r.w > 0), reverse=True)  # one row by term of the items
    stage_of, weight, before = np.full(max(1, len(vocabulary)), -1), np.zeros(max(1, len(vocabulary)), np.int64), 0
    total = sum(df for _, df, _ in known)
    for w, df, term in known:  # the rarest terms first; every owner holds about as many postings
        stage_of[term], weight[term] = before * STAGES // total, w
        before += df
    pairs, repeats = np.unique(np.array([(i, vocabulary[w]) for i, f in enumerate(found) for w in f] or np.zeros((0, 2)), np.int64).reshape(-1, 2), axis=0, return_counts=True)
    item_of, term_of = pairs[:, 0], pairs[:, 1]
    weight_of = weight[term_of] * repeats
    rows = cut(owned(counted, stage_of, n_docs, max(1, n_words)))
    none = [F.array().cast(f"array<{kind}>").alias(c) for c, kind in (("item", "int"), ("at", "int"), ("score", "long"))]
    bundles = rows.select("b").distinct().select("b", *none)
    for s in range(STAGES):
        mine, later = stage_of[term_of] == s, stage_of[term_of] > s
        rest = np.bincount(item_of[later], weight_of[later] * MOST, len(texts)).astype(np.int64) if later.any() else np.zeros(len(texts), np.int64)
        owner = rows.select("b", "at", "doc_id", F.col(f"t{s}").alias("t"), F.col(f"c{s}").alias("c"))
        if s < STAGES - 1:
            owner = owner.where(F.size("t") > 0).drop("doc_id")
        step = visit(s, (item_of[mine], term_of[mine], weight_of[mine]), rest, len(texts))
        schema = BUNDLE if s < STAGES - 1 else "item int, doc_id long, score long"
        bundles = bundles.groupBy("b").cogroup(owner.groupBy("b")).applyInArrow(step, schema)
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return bundles.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP)


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the TOP documents of each row of ``items`` (item_id, text), by integer scores above 0.

    Equal scores go by ascending doc_id, null last; rows that repeat a doc_id are documents of their own. A null or empty text
    (of an item or a document) has no terms, matches nothing and does not count as a document. Rows that repeat an
    item_id are searched each; items with equal texts are searched once. Texts are whole, whatever their length. Other
    columns are ignored. An empty table gives no rows.

    Items go in blocks of about ITEMS texts or ITEM_BYTES bytes, so their vocabulary, which the tasks that count words
    get, is bounded; each block reads the documents anew. Documents stand in blocks of 2 ** BLOCK_BITS rows in
    the order of the input, so neither a frequent term nor a hot source makes a large group. Terms are dealt to STAGES
    owners. A bundle carries the sparse accumulators of all items over one block of documents from owner to owner by
    cogroup, and each adds its integer contributions.
    """
    items = items.select("item_id", "text", text_key(F.col("text")).alias("key"))
    texts = items.where("text IS NOT NULL AND text <> ''").groupBy("key").agg(F.min("text").alias("text"), F.count("*").alias("weight"))
    texts = cut(texts)
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / ITEMS), math.ceil(size / ITEM_BYTES))
    found = None
    for k in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k).select("key", "text").orderBy("key").collect()  # bounded by ITEMS and ITEM_BYTES
        names = docs.sparkSession.createDataFrame([(i, r.key) for i, r in enumerate(rows)], "item int, key string")
        part = search_block(docs, [r.text for r in rows]).join(F.broadcast(names), "item").drop("item")
        found = part if found is None else found.unionByName(part)
    lists = found.groupBy("key").agg(F.collect_list(F.struct("rank", "doc_id", "score")).alias("hits"))  # TOP entries each
    rows = lookup(items.select("item_id", "key"), cut(lists.join(texts.select("key", "weight"), "key")), "key", "weight")
    return rows.select("item_id", F.inline("hits"))


@query(
    "op13_lexical_search",
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
iq AS (SELECT q, item_id, term, count(*) AS times FROM i GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS big_n, sum(len(ws))::BIGINT AS big_l FROM d WHERE len(ws) > 0),
tf AS (SELECT r, doc_id, len(ws)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, ws, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM iq) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, big_n),
scored AS (SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score
  FROM iq JOIN w USING (term) JOIN tf USING (term), s GROUP BY q, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""",
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
