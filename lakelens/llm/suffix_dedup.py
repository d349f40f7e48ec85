"""Removal of repeated byte strings by suffix arrays of the places where repeats can lie."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.base import bounded_batches, documents, query, ranges, shared_path, slices, utf8
from lakelens.llm.chosen_path import grouped
from lakelens.llm.suffix_sort import suffix_arrays
from lakelens.llm.terms import mixed
from lakelens.plans.session import cut, forget, lookup

LENGTH = 200  # bytes of a repeat
GRAM = 32  # bytes of an anchor; every string of LENGTH bytes holds one
SPAN = LENGTH - GRAM  # a string that holds the anchor at p starts in [p - SPAN, p]
TOGETHER = 12  # different surroundings of an anchor that are sorted together
BATCH = 1 << 20  # bytes of texts that are sorted side by side
SLICE = 1 << 20  # bytes whose anchors are found together

_P = np.array([0x9E3779B97F4A7C15], np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position; the last GRAM - 1 positions have none."""
    h, width, power = data.astype(np.uint64) + np.uint64(1), 1, _P
    while width < GRAM:
        h = h[:-width] * power + h[width:] if len(h) > width else h[:0]
        width, power = 2 * width, power * power
    return mixed(h)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions in ``data``, hashes, first and last start of their strings) of the anchors of each text.

    The anchor of a string of LENGTH bytes is the first of its grams with the smallest hash. Equal strings have their
    anchors at equal places, so repeats meet at anchors with equal hashes. Each string has one anchor, and
    the strings of an anchor start next to each other.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    h = gram_hashes(data[lo:hi])
    windows = len(h) - SPAN
    if windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.uint64((1 << 24) - 1)
    if len(h) <= int(low):  # high bits of the hash, then the position: the minimum is the first of the smallest
        coded = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    else:  # one text of over 16 MB, in parts that overlap by all but one byte of a string
        step = int(low) // 2
        found = [anchors(data, np.array([a, min(hi, a + step + LENGTH - 1)])) for a in range(lo, hi - LENGTH + 1, step)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    size = SPAN + 1
    padded = np.concatenate([coded, np.full(-len(coded) % size, np.uint64(2**64 - 1))]).reshape(-1, size)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:windows], ahead[SPAN : SPAN + windows])
    at = (least & low).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: windows] - lo
    inside = np.flatnonzero(np.arange(windows) + LENGTH <= ends)
    at = at[inside]
    head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    last = np.append(head[1:], len(at))[: len(head)] - 1
    return at[head] + lo, h[at[head]], inside[head] + lo, inside[last] + lo


def packed_bytes(flat: np.ndarray) -> np.ndarray:
    """Bytes i to i + 7 of each position of a text (bytes plus 2, ends below), as one number."""
    out = (np.maximum(flat, 2) - 2).astype(np.uint64)
    for width in (1, 2, 4):
        out = out | np.append(out[width:], np.zeros(min(width, len(out)), np.uint64)) << np.uint64(8 * width)
    return out


def repeated_starts(bodies: list[list[bytes]], counts: list[np.ndarray]) -> list[list[np.ndarray]]:
    """For each group of different bodies: the starts of their strings of LENGTH bytes that start more than once in the group.

    ``counts`` says how often each body is there. One suffix array by group, all of them side by side: equal
    strings are neighbours in it.
    """
    out = [[None] * len(b) for b in bodies]
    order = sorted(range(len(bodies)), key=lambda g: sum(map(len, bodies[g])))
    i = 0
    while i < len(order):
        batch, total = [], 0
        while i < len(order) and (not batch or total < BATCH):
            batch.append(order[i])
            total += sum(map(len, bodies[order[i]]))
            i += 1
        lengths = [[len(b) + 1 for b in bodies[g]] for g in batch]
        flat = np.frombuffer(b"\xff".join(b"\xff".join(bodies[g]) for g in batch) + b"\xff", np.uint8).astype(np.int64) + 2
        body_ends = np.cumsum([n for ls in lengths for n in ls])
        flat[body_ends - 1] = 1  # between bodies
        ends = np.cumsum([sum(ls) for ls in lengths])
        flat[ends - 1] = 0  # ends of texts
        array = suffix_arrays(flat, np.concatenate([[0], ends]))
        body = np.searchsorted(body_ends, array, "right")
        valid = array + LENGTH < body_ends[body]
        array, body = array[valid], body[valid]
        group = np.searchsorted(ends, array, "right")
        same = np.zeros(len(array), bool)  # as the one before
        pair = np.flatnonzero(group[1:] == group[:-1]) + 1
        eight = packed_bytes(flat)
        for at in range(0, LENGTH, 8):
            pair = pair[eight[array[pair] + at] == eight[array[pair - 1] + at]]
        same[pair] = True
        often = np.concatenate([counts[g] for g in batch])[body] > 1
        hit = same | often
        hit[:-1] |= same[1:]
        at, of = array[hit], body[hit]
        order_hit = np.lexsort((at, of))
        at, of = at[order_hit], of[order_hit]
        first = np.concatenate([[0], body_ends[:-1]])
        cuts = np.searchsorted(of, np.arange(len(body_ends) + 1))
        k = 0
        for g in batch:
            for b in range(len(bodies[g])):
                out[g][b] = at[cuts[k] : cuts[k + 1]] - first[k]
                k += 1
    return out


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals that are given by ascending starts, as maximal runs."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])


RUNS = "array<struct<a: int, b: int>>"


def runs_of(found: list[np.ndarray]) -> pa.ListArray:
    """The ascending starts of each body as runs [a, b)."""
    sizes = np.array([len(f) for f in found], np.int64)
    at, owner = np.concatenate([*found, np.zeros(0, np.int64)]), np.repeat(np.arange(len(found)), sizes)
    new = np.flatnonzero((np.diff(at, prepend=-2) > 1) | (np.diff(owner, prepend=-1) > 0))
    runs = [pa.array(x.astype(np.int32)) for x in (at[new], at[np.append(new[1:], len(at))[: len(new)] - 1] + 1)]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(found)))])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays(runs, ["a", "b"]))


def solve(batches):
    """(key, body, runs of starts) of groups with at most TOGETHER bodies, in partitions sorted by key."""

    def flush(held):
        rows = pa.Table.from_batches(held)
        keys, pieces, n = rows["bucket"].to_numpy(), rows["piece"].to_pylist(), rows["n"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).tolist()
        groups = list(zip(cuts[:-1], cuts[1:], strict=True))
        found = repeated_starts([pieces[i:j] for i, j in groups], [n[i:j] for i, j in groups])
        return pa.RecordBatch.from_arrays([pa.array(keys), rows["body"].combine_chunks(), runs_of([f for g in found for f in g])], names=["key", "body", "starts"])

    held, total = [], 0
    for batch in (b for b in batches if b.num_rows):
        if total > 4 * BATCH:  # a group may go on in the next batch
            more = batch.column("bucket").to_numpy() != held[-1].column("bucket")[-1].as_py()
            head = int(more.argmax()) if more.any() else batch.num_rows
            held.append(batch.slice(0, head))
            if head < batch.num_rows:
                yield flush(held)
                held, total, batch = [], 0, batch.slice(head)
            else:
                continue
        held.append(batch)
        total += batch.column("piece").nbytes
    if held:
        yield flush(held)


def halves(batches):
    """The bodies of groups too large to be sorted together, cut into two ranges of their strings.

    A row holds strings that start in [low, high] bytes before the anchor. All strings of one range share a
    core around the anchor; its hash is the new key, so bodies that differ inside it part.
    """
    for batch in batches:
        out = []
        cols = [batch.column(c).to_pylist() for c in ("key", "body", "piece", "anchor", "low", "high", "n")]
        for key, body, piece, anchor, low, high, n in zip(*cols, strict=True):
            middle = (low + high) // 2
            for a, b in ((low, middle), (middle + 1, high)):
                start, end = max(0, anchor - b), min(len(piece), anchor - a + LENGTH)
                if a > b or end - start < LENGTH:
                    continue
                core = piece[max(0, anchor - a) : anchor - b + LENGTH]
                part = piece[start:end]
                new = int.from_bytes(hashlib.blake2b(key.to_bytes(8, "little", signed=True) + bytes([a, b]) + core, digest_size=8).digest(), "little", signed=True)
                out.append((key, body, new, name_of(part, anchor - start), part, anchor - start, start, a, b, n))
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        names = ["key", "body", "new_key", "new_body", "piece", "anchor", "shift", "low", "high", "n"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(10)], names=names)


HALVES = "key long, body binary, new_key long, new_body binary, piece binary, anchor int, shift int, low int, high int, n long"


def name_of(piece: bytes, anchor: int) -> bytes:
    return xxhash.xxh3_128_digest(piece, anchor)


def resolve(units: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """(key, body, starts): the repeated strings of each body, among all bodies with its key, as runs [a, b) of their starts.

    ``units`` has one row by (key, body): piece, anchor, low, high, n (how often it is there). Keys of one
    body need no sorting: its strings repeat if it is there twice. Keys of up to TOGETHER bodies are
    sorted in one suffix array. Larger ones are halved until they are small or all bodies are the
    same, eight times at most, since a range of one string is its own core. So no task holds a large key.
    ``units`` is written anew and then removed; ``spent`` gets the written steps that the caller may remove after the result.
    """
    sizes = units.groupBy("key").agg(F.count("*").alias("weight"))
    known = lookup(units, sizes.withColumn("bodies", F.col("weight")), "key", "weight")
    known = cut(known)
    forget(units)  # nothing else reads them
    spent.append(known)
    every = F.array(F.struct(F.lit(0).alias("a"), (F.octet_length("piece") - LENGTH + 1).alias("b")))
    one = known.where("bodies = 1").select("key", "body", F.when(F.col("n") > 1, every).otherwise(F.array().cast(RUNS)).alias("starts"))
    some = known.where(F.col("bodies").between(2, TOGETHER)).select(F.col("key").alias("bucket"), "body", "piece", "n")
    out = one.unionByName(grouped(some).mapInArrow(solve, f"key long, body binary, starts {RUNS}"))
    many = known.where(F.col("bodies") > TOGETHER)
    if many.isEmpty():
        return out
    parts = cut(many.mapInArrow(halves, HALVES))
    new = parts.groupBy("new_key", "new_body").agg(*[F.first(c).alias(c) for c in ("piece", "anchor", "low", "high")], F.sum("n").alias("n"))
    new = cut(new.withColumnsRenamed({"new_key": "key", "new_body": "body"}))
    inner = []
    found = cut(resolve(new, inner).where(F.size("starts") > 0).withColumnsRenamed({"key": "new_key", "body": "new_body"}))
    forget(*inner)
    spent += [parts, found]
    weights = parts.groupBy("new_key", "new_body").agg(F.count("*").alias("weight"))
    found = found.join(weights, ["new_key", "new_body"]).withColumn("child", F.concat(F.hex("new_body"), F.hex("new_key"))).select("child", "starts", "weight")
    back = lookup(parts.select("key", "body", "shift", F.concat(F.hex("new_body"), F.hex("new_key")).alias("child")), found, "child", "weight", 0)
    back = back.select("key", "body", F.transform("starts", lambda s: F.struct((s["a"] + F.col("shift")).alias("a"), (s["b"] + F.col("shift")).alias("b"))).alias("starts"))
    return out.unionByName(back.groupBy("key", "body").agg(F.flatten(F.collect_list("starts")).alias("starts")))


def small(batches, rows: int = 256):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def different_texts(docs: DataFrame) -> DataFrame:
    """(t, text, copies) of the different texts of LENGTH bytes and more, in a table with as many buckets of t as a shuffle has partitions.

    Later joins on t move their other side to the texts, so texts are shuffled once. Copies are combined before that.
    """
    spark, path = docs.sparkSession, shared_path(docs.sparkSession)
    rows = docs.where(F.octet_length("text") >= LENGTH).groupBy(F.unhex(F.md5("text")).alias("t")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name = f"texts_{uuid.uuid4().hex}"
    rows.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "t").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._cut_path = path
    return out


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept_sha256) for every row of ``docs``: the bytes that repeats cover, and what is left.

    Each whole text is its UTF-8 bytes, null is empty; strings never cross documents. ``spans`` are the maximal runs
    [start, end) of bytes that lie in a string of LENGTH bytes which also starts elsewhere, in any
    document or the same one, overlaps included; all strings are judged on the input. Rows that repeat a
    doc_id are documents of their own.

    A string of LENGTH bytes has an anchor, its smallest gram; equal strings have equal anchors at equal places.
    Anchors that are there once are dropped. The surroundings of the others (at most 368 bytes) hold all strings with
    this anchor; equal surroundings are counted once, and different ones of an anchor are suffix-sorted together
    (``resolve``). So only places where texts begin or end to agree are sorted, whatever the size of the
    corpus. The same text in many documents is one text with a count.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = different_texts(docs)

    def find(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets, SLICE):
                at, h, first, last = anchors(data, offsets[i : j + 1])
                row, low = i + np.searchsorted(offsets[i : j + 1], at, "right") - 1, int(offsets[i])
                raw = data[low : int(offsets[j])].tobytes()
                pieces = zip((first - low).tolist(), (last - low + LENGTH).tolist(), (at - first).tolist(), strict=True)
                bodies = pa.array([name_of(raw[a:b], k) for a, b, k in pieces], pa.binary())
                places = [pa.array((x - offsets[row]).astype(np.int32)) for x in (first, last, at)]
                names, copies = batch.column("t").take(pa.array(row)), batch.column("copies").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), bodies, names, *places, copies], names=["key", "body", "t", "first", "last", "at", "n"])

    places = cut(whole.mapInArrow(find, "key long, body binary, t binary, first int, last int, at int, n long"))
    # two hashes of the body tell a key of one body from others
    marks = places.select("key", "n", F.xxhash64("body").alias("x"), F.xxhash64(F.lit(1), "body").alias("y")).groupBy("key")
    shared = marks.agg(F.count("*").alias("weight"), F.sum("n").alias("all"), ((F.min("x") == F.max("x")) & (F.min("y") == F.max("y"))).alias("alone"))
    shared = cut(shared.where("all > 1").drop("all"))
    bodies = lookup(places, shared, "key", "weight", 0).groupBy("key", "body", "alone")
    bodies = bodies.agg(F.sum("n").alias("n"), F.min(F.struct("t", "first", "last", "at")).alias("o"), F.count("*").alias("rows"))
    bodies = cut(bodies.select("key", "body", "alone", "n", "o.*", "rows"))
    forget(shared)

    def owned(batches):
        """The pieces of the bodies that each text owns; one row by text comes in."""
        for batch in small(batches):
            data, offsets = utf8(batch.column("text"))
            out = [[], [], [], [], []]
            for k, owns in enumerate(batch.column("owns").to_pylist()):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                for o in owns:
                    piece = text[o["first"] : o["last"] + LENGTH]
                    for column, value in zip(out, (o["key"], o["body"], o["n"], piece, o["at"] - o["first"]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32()), strict=True)], names=["key", "body", "n", "piece", "anchor"])

    # the strings of a key of one body repeat, since it is there twice: no piece is needed
    every = F.array(F.struct(F.lit(0).alias("a"), (F.col("last") - F.col("first") + 1).alias("b")))
    lone = bodies.where("alone").select("body", every.alias("starts"), F.col("rows").alias("weight"))
    owners = bodies.where("NOT alone").groupBy("t").agg(F.collect_list(F.struct("key", "body", "first", "last", "at", "n")).alias("owns"))
    units = whole.select("t", "text").join(owners, "t").mapInArrow(owned, "key long, body binary, n long, piece binary, anchor int")
    units = cut(units.select("*", F.lit(0).alias("low"), F.lit(SPAN).alias("high")))
    spent = []
    found = cut(resolve(units, spent).where(F.size("starts") > 0))
    forget(*spent)
    found = found.join(bodies.select("key", "body", "rows"), ["key", "body"]).select("body", "starts", F.col("rows").alias("weight"))
    hits = lookup(places.select("body", "t", "first"), lone.unionByName(found), "body", "weight", 0)
    hits = hits.groupBy("t").agg(F.collect_list(F.struct("first", "starts")).alias("hits"))

    def strip(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            spans, digests = [], []
            lists = batch.column("hits")
            first, starts = lists.values.flatten()
            a, b = (x.to_numpy() for x in starts.values.flatten())
            ends = starts.offsets.to_numpy()
            shift = np.repeat(first.to_numpy().astype(np.int64), np.diff(ends))
            a, b = a[ends[0] : ends[-1]] + shift, b[ends[0] : ends[-1]] + shift + LENGTH - 1
            cuts = ends[lists.offsets.to_numpy()] - ends[0]
            for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                text = data[offsets[k] : offsets[k + 1]]
                order = np.argsort(a[i:j], kind="stable")
                low, high = merged(a[i:j][order], b[i:j][order])
                keep = np.ones(len(text), bool)
                keep[ranges(low, high - low)] = False
                spans.append([{"start": a, "end": b} for a, b in zip(low.tolist(), high.tolist(), strict=True)])
                digests.append(hashlib.sha256(text[keep].tobytes()).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(spans, kind), pa.array(digests), batch.column("copies")], names=["t", "spans", "kept", "weight"])

    schema = "t binary, spans array<struct<start: long, end: long>>, kept string, weight long"
    results = cut(whole.select("t", "text", "copies").join(hits, "t").mapInArrow(strip, schema))
    forget(places, bodies, whole)
    rest = docs.select("doc_id", F.unhex(F.md5("text")).alias("t"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"))
    touched = lookup(rest, results, "t", "weight", 0)
    untouched = rest.join(results.select("t").hint("merge"), "t", "left_anti")
    none = F.array().cast("array<struct<start: long, end: long>>")
    out = touched.select("doc_id", "n_bytes", "spans", F.col("kept").alias("kept_sha256"))
    return out.unionByName(untouched.select("doc_id", "n_bytes", none.alias("spans"), F.col("own").alias("kept_sha256")))


@query("op1_suffix_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    rows = repeats(documents(spark, folder))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
