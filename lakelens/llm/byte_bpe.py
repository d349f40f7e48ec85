"""Byte-level BPE on executors: length-bucketed padded matrices, one leftmost minimum-rank merge for every row each round."""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.base import bounded_batches, documents, query, ranges, slices, utf8

WIDTHS = (4, 8, 16, 32, 64, 128, 256, 512)  # bytes of a row of each matrix
CELLS = 1 << 20  # cells of a matrix
MEMORY = 48 << 20  # bytes of pieces that a worker remembers
SLICE = 2 << 20  # bytes of text that are encoded together

_NONE = np.int32(2**31 - 1)


class PairTable:
    """Hashed lookup of (left id, right id) -> id of their joined bytes: open addressing in flat arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, np.uint64(2**64 - 1)), np.full(size, _NONE, np.int32)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):  # every round one key takes each free slot it asks for
            slot = self._slot(keys[left], self.probes)
            free = np.flatnonzero(self.keys[slot] == np.uint64(2**64 - 1))
            taken, first = np.unique(slot[free], return_index=True)
            won = left[free[first]]
            self.keys[taken], self.values[taken] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        h = ((keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return ((h + np.uint64(probe)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the joined pairs, _NONE where there is no such token or an id is negative."""
        out = np.full(len(a), _NONE, np.int32)
        left = np.flatnonzero((a >= 0) & (b >= 0))
        keys = (a[left].astype(np.uint64) << np.uint64(32)) | b[left].astype(np.uint64)
        for probe in range(self.probes):
            slot = self._slot(keys, probe)
            found = self.keys[slot]
            hit = found == keys
            out[left[hit]] = self.values[slot[hit]]
            more = ~hit & (found != np.uint64(2**64 - 1))
            left, keys = left[more], keys[more]
            if not len(left):
                break
        return out


class ByteBpe:
    """Encodes and decodes by the ranks of a tiktoken file; a piece that is itself a token is that token.

    ``pattern`` cuts texts into pieces. Every other piece starts as its bytes, and the leftmost pair whose joined
    bytes have the smallest rank is merged until no pair is a token. Pieces are encoded once while they are remembered
    (``memory`` bytes of them, then the memory starts anew).
    """

    def __init__(self, path: str, pattern: str, memory: int = MEMORY):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.cut, self.memory = regex.compile(pattern).findall, memory
        top = max(self.ranks.values()) + 1
        self.lengths = np.full(top, -1, np.int64)
        for token, i in self.ranks.items():
            self.lengths[i] = len(token)
        self.starts = np.cumsum(np.maximum(self.lengths, 0)) - np.maximum(self.lengths, 0)
        self.data = np.frombuffer(b"".join(token for _, token in sorted((i, t) for t, i in self.ranks.items())), np.uint8)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:k]] << 32 | self.ranks[t[k:]], i) for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.pairs = PairTable(np.array([k for k, _ in pairs], np.uint64), np.array([v for _, v in pairs], np.int32))
        self.forget()

    def forget(self) -> None:
        self.codes, self.held = {}, 0
        self.piece_starts, self.piece_lengths, self.piece_ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def merge_matrix(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of pieces of at most ``width`` bytes, side by side."""
        n = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        cells = np.full((len(pieces), width), -1, np.int32)
        cells[np.repeat(np.arange(len(pieces)), n), ranges(np.zeros(len(n), np.int64), n)] = self.byte_ids[raw]
        ranks = np.full((len(pieces), width), _NONE, np.int32)
        ranks[:, :-1] = self.pairs(cells[:, :-1].ravel(), cells[:, 1:].ravel()).reshape(len(pieces), width - 1)
        out, rows, columns = np.full_like(cells, -1), np.arange(len(pieces)), np.arange(width)
        while len(rows):
            at = ranks.argmin(1)  # the first of the smallest
            each = np.arange(len(rows))
            best = ranks[each, at]
            more = best != _NONE
            if not more.all():  # rows without a pair leave
                out[rows[~more]] = cells[~more]
                cells, ranks, rows, at, best = cells[more], ranks[more], rows[more], at[more], best[more]
                each = each[: len(rows)]
                if not len(rows):
                    break
            cells[each, at] = best
            # close the gap behind the merged pair
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            cells = np.take_along_axis(cells, source, 1)
            cells[:, -1] = -1
            ranks = np.take_along_axis(ranks, source, 1)
            ranks[:, -1] = _NONE
            after = np.minimum(at + 1, width - 1)
            ranks[each, at] = np.where(at + 1 < width, self.pairs(best, cells[each, after]), _NONE)
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.pairs(cells[before, at[before] - 1], best[before])
        kept = out >= 0
        return out[kept], kept.sum(1)

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same for one piece beyond the widest matrix: pairs wait in a heap by rank and place, n log n."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        rank = self.pairs(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(rank[i]), int(i), ids[i], ids[i + 1]) for i in np.flatnonzero(rank != _NONE)]
        heapq.heapify(heap)
        size = self.lengths
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        known: dict[tuple[int, int], int] = {}

        def push(i, j):
            pair = (ids[i], ids[j])
            if pair not in known:
                known[pair] = int(self.pairs(np.array(pair[:1], np.int32), np.array(pair[1:], np.int32))[0])
            if known[pair] != _NONE:
                heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([x for x in ids if x >= 0 and size[x] >= 0], np.int32)

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of ids of each)."""
        found: list = [None] * len(pieces)
        order = sorted((i for i, p in enumerate(pieces) if p not in self.ranks), key=lambda i: len(pieces[i]))
        for i, p in enumerate(pieces):
            if p in self.ranks:
                found[i] = np.array([self.ranks[p]], np.int32)
        low = 0
        for width in WIDTHS:
            high = low
            while high < len(order) and len(pieces[order[high]]) <= width:
                high += 1
            step = CELLS // width
            for a in range(low, high, step):
                part = order[a : min(high, a + step)]
                ids, n = self.merge_matrix([pieces[i] for i in part], width)
                for i, own in zip(part, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                    found[i] = own
            low = high
        for i in order[low:]:
            found[i] = self.merge_long(pieces[i])
        return np.concatenate([*found, np.zeros(0, np.int32)]), np.array([len(f) for f in found], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        if self.held > self.memory:
            self.forget()
        known, per_text, new = self.codes, [], []
        for text in texts:
            pieces = self.cut(text)
            for p in set(pieces):
                if p not in known:
                    known[p] = len(known)
                    new.append(p)
            per_text.append(np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces)))
        if new:
            ids, n = self.merged([p.encode() for p in new])
            self.piece_starts = np.concatenate([self.piece_starts, len(self.piece_ids) + np.cumsum(n) - n])
            self.piece_lengths, self.piece_ids = np.concatenate([self.piece_lengths, n]), np.concatenate([self.piece_ids, ids])
            self.held += 176 * len(new) + 5 * sum(map(len, new))
        codes = np.concatenate([*per_text, np.zeros(0, np.int64)])
        lengths = self.piece_lengths[codes]
        before = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum([len(c) for c in per_text], dtype=np.int64)
        return self.piece_ids[ranges(self.piece_starts[codes], lengths)], np.diff(before[ends], prepend=0)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids in a row, number of bytes of each); an id that is no token fails."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or self.lengths[ids].min() < 0):
            raise ValueError("an id is not in the vocabulary")
        return self.data[ranges(self.starts[ids], self.lengths[ids])], self.lengths[ids]


@lru_cache(maxsize=2)
def _bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _field(docs: DataFrame, name: str):
    return f"`{name}` {dict(docs.dtypes)[name]}"


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(``key``, ids): the token ids of every whole text, one row for each row of ``docs``.

    Null and empty texts have no ids. Keys may repeat or be null; equal rows are encoded alike. Special tokens in a text are
    ordinary text. Texts go through in slices of about SLICE bytes, one longer text by itself. Pieces of up to 512 bytes are
    merged in matrices of their own width; longer ones (text without any cut) one by one. There is no shuffle. Other
    columns are ignored. ``path`` must be readable on all executors.
    """

    def run(batches):
        bpe = _bpe(path, pattern)
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, SLICE):
                ids, n = bpe.encode(batch.column(1).slice(i, j - i).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=[key, "ids"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"{_field(docs, key)}, ids array<int>")


def decode(rows: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(``key``, ids, bytes) of (``key``, ids): the bytes that the ids stand for; null ids are none.

    An id that is not in the vocabulary fails the job.
    """

    def run(batches):
        bpe = _bpe(path, pattern)
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            for i, j in slices(offsets, SLICE // 4):
                ids = lists.values.slice(offsets[i], offsets[j] - offsets[i]).to_numpy()
                data, n = bpe.decode(ids)
                ends = np.concatenate([[0], np.cumsum(n)])[offsets[i : j + 1] - offsets[i]]
                found = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists.slice(i, j - i), found], names=[key, "ids", "bytes"])

    bounded_batches(rows.sparkSession)
    rows = rows.select(key, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, f"{_field(rows, key)}, ids array<int>, bytes binary")


def public_bpe() -> tuple[str, str]:
    """(file, pattern) of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op12_byte_bpe")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    rows = decode(encode(documents(spark, folder), *public_bpe()), *public_bpe())
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
