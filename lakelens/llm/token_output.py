"""Token ids of whole documents in ORC: integer run lengths, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.base import bounded_batches, documents, query, ranges, shared_path, slices, texts, utf8

MEMORY = 128 << 20  # bytes of chunks, and of pieces, that a worker remembers
SLICE = 2 << 20  # bytes of text that are encoded together
STRIPE = 8 << 20  # bytes of an ORC stripe, which also bounds the writer's memory

# str.split() cuts at these, the tokenizer does not
_SEPARATORS = re.compile("[\x1c-\x1f]")


class _Codes(dict):
    """Numbers new keys in order of appearance and notes them."""

    def __init__(self):
        self.new = []

    def __missing__(self, key):
        self[key] = code = len(self)
        self.new.append(key)
        return code


# The settings of a tokenizer file under which its chunks fall into pieces as below. With others all chunks go to it whole.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

# Chunks that this pattern cuts into pieces; all others go to the tokenizer whole.
_PLAIN = re.compile("[!-;=-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class _Table:
    """Numbered strings and the ids of each, in flat arrays."""

    def __init__(self):
        self.codes, self.lengths, self.starts, self.ids = _Codes(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.held = 0  # bytes, about

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """The ids of the strings that were new, in the order of their numbers."""
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        self.held += 176 * len(lengths) + 2 * sum(map(len, self.codes.new)) + 4 * len(ids)
        self.codes.new = []

    def numbers(self, strings: list[str]) -> np.ndarray:
        return np.fromiter(map(self.codes.__getitem__, strings), np.int64, len(strings))

    def gather(self, codes: np.ndarray) -> np.ndarray:
        return self.ids[ranges(self.starts[codes], self.lengths[codes])]


class ChunkEncoder:
    """Encodes texts with a tokenizers file whose tokens never cross white space, in lower case with word ends.

    The ids of a text are the ids of its white-space separated chunks, and those of a chunk the ids of its
    pieces, so each distinct piece goes through the tokenizer once while it is remembered; ``memory`` bytes of
    chunks and as many of pieces are remembered, then that memory starts anew. Where the file's own settings are not
    those that the pieces are cut by, or it asks for something before or after, whole texts go to the tokenizer.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.tokenizer, self.memory = Tokenizer.from_file(path), memory
        settings = json.loads(self.tokenizer.to_str())
        cuts = {"type": "Sequence", "pretokenizers": [CUT, BYTES]}
        self.known = settings["normalizer"] == NORMALIZER and settings["pre_tokenizer"] == cuts and not (settings["truncation"] or settings["padding"])
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.chunks, self.pieces = _Table(), _Table()

    def plain(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        lengths = np.array([len(f) for f in found], np.int64)
        return np.fromiter(chain.from_iterable(found), np.int64, int(lengths.sum())), lengths

    def learn_pieces(self) -> None:
        """New pieces go in all at once, set apart by blanks; a piece ends with its only word-end token."""
        new = self.pieces.codes.new
        ids = np.array(self.tokenizer.encode(" ".join(new), add_special_tokens=False).ids, np.int64)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) == len(new):
            self.pieces.add(ids, np.diff(ends, prepend=0))
        else:
            self.pieces.add(*self.plain(new))

    def learn(self) -> None:
        new = self.chunks.codes.new
        if self.pieces.held > self.memory:
            self.pieces = _Table()
        cuts = [_PIECES.findall(c.lower()) if self.known and _PLAIN.fullmatch(c) else [] for c in new]
        codes = self.pieces.numbers(list(chain.from_iterable(cuts)))
        if self.pieces.codes.new:
            self.learn_pieces()
        per_chunk = np.array([len(c) for c in cuts], np.int64)
        before = np.concatenate([[0], np.cumsum(self.pieces.lengths[codes])])
        ends = np.cumsum(per_chunk)
        lengths = before[ends] - before[ends - per_chunk]
        ids, odd = self.pieces.gather(codes), np.flatnonzero(per_chunk == 0)
        if len(odd):  # the odd ones' ids go behind the others
            odd_ids, odd_lengths = self.plain([new[i] for i in odd])
            starts = np.cumsum(lengths) - lengths
            starts[odd], lengths[odd] = len(ids) + np.cumsum(odd_lengths) - odd_lengths, odd_lengths
            ids = np.concatenate([ids, odd_ids])[ranges(starts, lengths)]
        self.chunks.add(ids, lengths)

    def encode(self, texts: list[str], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids by text); ``end_id`` closes each text."""
        if self.chunks.held > self.memory:
            self.chunks = _Table()
        found = [self.chunks.numbers(t.split() if self.known and not _SEPARATORS.search(t) else [t]) for t in texts]
        if self.chunks.codes.new:
            self.learn()
        codes = np.concatenate([*found, np.zeros(0, np.int64)])
        ids = self.chunks.gather(codes)
        chunks = np.array([len(f) for f in found], np.int64)
        before = np.concatenate([[0], np.cumsum(self.chunks.lengths[codes])])
        ends = np.cumsum(chunks)
        counts = before[ends] - before[ends - chunks]
        if end_id is None:
            return ids, counts
        out = np.full(len(ids) + len(texts), end_id, np.uint32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(counts + 1) - 1] = False
        out[inner] = ids
        return out, counts + 1


@lru_cache(maxsize=2)
def _encoder(path: str) -> ChunkEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    return ChunkEncoder(path)


SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, shards: int | None = None, stripe: int = STRIPE) -> None:
    """Encode whole texts and write their ids to ORC files in ascending order of doc_id.

    Null texts are empty (only the end id is written), null ids come first, equal ids are ordered by text.
    Each file has a shard number and the token position of each document within the shard, so positions
    in the whole corpus need one small sum by shard. Rows are range-partitioned by id, text hash and their place in the
    input, so neither a repeated id nor equal rows fill one range; equal rows are written as often as they are there.
    Texts of any length are encoded whole. Stripes are of about ``stripe`` bytes, so that a file has several.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumns({"h": F.xxhash64("text"), "salt": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(shards, "doc_id", "h", "salt") if shards else rows.repartitionByRange("doc_id", "h", "salt")
    rows = rows.sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def encode(batches):
        encoder, start, shard = _encoder(tokenizer), 0, TaskContext.get().partitionId()
        for whole in batches:
            for i, j in slices(utf8(whole.column(1))[1], SLICE):
                part = whole.slice(i, j - i)
                ids, counts = encoder.encode(part.column(1).to_pylist(), end_id)
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(len(counts), shard, np.int32)), pa.array(start + ends - counts), pa.array(counts), lists],
                    names=["doc_id", "shard", "shard_start", "n_tokens", "ids"],
                )
                start += int(counts.sum())

    out = rows.mapInArrow(encode, SCHEMA).write.option("orc.compress", "zstd").option("orc.create.index", "true")
    out.option("orc.row.index.stride", "1000").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.stripe.size", str(stripe)).option("orc.rows.between.memory.checks", "200").orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids); ``start`` counts the ids of all documents before.

    Stripes are read in parallel. The shard sums are one row per file, which the driver adds up.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    sums = sorted(tuple(r) for r in rows.groupBy("shard").agg(F.sum("n_tokens")).collect())  # one row per file
    before, at = {}, 0
    for shard, n in sums:
        before[shard], at = at, at + n
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "shard int, before long")
    joined = rows.join(F.broadcast(offsets), "shard")
    return joined.select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), F.size("ids").cast("long").alias("n_tokens"), "ids")


def find_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Tokens of the named documents; file and stripe statistics and Bloom filters skip the rest."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def _digests(batches):
    for b in batches:
        lists = b.column("ids")
        values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        sums = [zlib.crc32(values[i:j].tobytes()) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of ``read_tokens``."""
    return tokens.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_token_output")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark)
    write_tokens(documents(spark, folder), path, tokenizer_path(), end_id=2)
    return token_digests(read_tokens(spark, path))


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: the token files of ``docs``, read back."""
    path = shared_path(spark)
    write_tokens(texts(docs), path, tokenizer_path(), end_id=2)
    return token_digests(read_tokens(spark, path))
