"""Quality classifier: gated attention over the passages of a document (multiple-instance learning)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.llm.base import bounded_batches, documents, packed, query, slices, utf8
from lakelens.llm.terms import word_bounds, word_hashes
from lakelens.llm.toxicity import held_out, training_rows
from lakelens.sources.io import table

PASSAGE = 64  # words
BUCKETS = 64  # of hashed words

# Classes of bytes: other, lower case, upper case, digits, beyond ASCII, blanks, line ends, and groups of signs.
_GROUPS = ("", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "", " \t", "\n\r", ".", ",", ";:", "!", "?", "|/\\\\", "\"'`", "()[]", "-_", "<>={}", "#$%&*@+^~")
_CLASS = np.zeros(256, np.int64)
_CLASS[128:] = 4
for _k, _signs in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _signs]] = _k
CLASSES = len(_GROUPS)
WIDTH = BUCKETS + CLASSES + 5


def encode_passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages x WIDTH, bounds): every text in passages of PASSAGE words, the last one shorter; at least one passage by text.

    A passage is encoded by the shares of its words in hash buckets, the shares of its bytes in classes
    of characters, bytes and bytes per word, the shares of words equal to the one before and of words that are new, and lines.
    """
    part, edges = data[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0]
    starts, ends = word_bounds(part)
    seams = edges[1:-1]
    if len(starts) and len(seams):  # a run over the seam of two texts is cut there
        at = np.maximum(np.searchsorted(starts, seams, "right") - 1, 0)
        seams = np.unique(seams[(starts[at] < seams) & (ends[at] > seams)])
        starts, ends = np.sort(np.concatenate([starts, seams])), np.sort(np.concatenate([ends, seams]))
    first = np.searchsorted(starts, edges)  # first word of each text
    passages = np.maximum(1, -(-np.diff(first) // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(passages)])
    doc = np.repeat(np.arange(len(passages)), passages)
    order = np.arange(bounds[-1]) - bounds[doc]
    low = first[doc] + order * PASSAGE
    count = np.minimum(low + PASSAGE, first[doc + 1]) - low
    # a passage reaches from its first word to that of the next; the outer ones reach the ends of the text
    begin = np.where(order == 0, edges[doc], np.append(starts, 0)[np.minimum(low, len(starts))])
    size = np.diff(np.append(begin, edges[-1]))
    n = len(low)
    of_byte = np.repeat(np.arange(n) * CLASSES, size)
    classes = np.bincount(of_byte + _CLASS[part], minlength=n * CLASSES).reshape(n, CLASSES)
    (h,) = word_hashes(part, starts, ends)
    of_word = np.repeat(np.arange(n), count)
    buckets = np.bincount(of_word * BUCKETS + (h >> np.uint64(58)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    same = of_word[1:] == of_word[:-1]
    again = np.bincount(of_word[1:][same & (h[1:] == h[:-1])], minlength=n)
    key = np.sort((of_word.astype(np.uint64) << np.uint64(38)) | (h >> np.uint64(26)))
    new = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    distinct = np.bincount((new >> np.uint64(38)).astype(np.int64), minlength=n)
    words, wide = np.maximum(count, 1), np.maximum(size, 1)
    rest = [np.log1p(size), np.log1p(wide / words), again / words, distinct / words, classes[:, 6] / words]
    out = np.concatenate([buckets / words[:, None], classes / wide[:, None], np.stack(rest, 1)], 1)
    return out.astype(np.float32), bounds


@dataclass
class AttentionModel:
    """Gated attention over passages: h = relu(Wx + b), a = softmax(w (tanh(Vh) * sigmoid(Uh))), score = sigmoid(c sum(a h) + d).

    Labels belong to documents only; the attention learns which passages speak for them.
    """

    hidden: int = 32
    gate: int = 16
    epochs: int = 5
    batch: int = 64
    rate: float = 3e-3
    decay: float = 1e-4
    seed: int = 11

    def fit(self, x: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> AttentionModel:
        rng = np.random.default_rng(self.seed)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32))
        share = (labels.sum() + 1) / (len(labels) + 2)
        draw = lambda *shape: (rng.normal(0, 1 / np.sqrt(shape[0]), shape)).astype(np.float32)
        p = self.params = {"W": draw(WIDTH, self.hidden), "b": np.zeros(self.hidden, np.float32), "V": draw(self.hidden, self.gate), "U": draw(self.hidden, self.gate), "w": draw(self.gate), "c": draw(self.hidden) * (len(labels) > 0), "d": np.array(np.log(share / (1 - share)), np.float32)}
        first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
        x = self._scaled(x)
        for epoch in range(self.epochs):
            order = rng.permutation(len(labels))
            rate = self.rate * (1 - epoch / self.epochs)
            for at in range(0, len(order), self.batch):
                pick = np.sort(order[at : at + self.batch])
                rows = [x[bounds[i] : bounds[i + 1]] for i in pick]
                own = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
                step += 1
                for k, g in self._gradients(np.concatenate(rows), own, labels[pick]).items():
                    g = g + self.decay * p[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def _forward(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
        p, n = self.params, np.diff(own)
        h = np.maximum(x @ p["W"] + p["b"], 0)
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, own[:-1]), n))
        a = e / np.repeat(np.add.reduceat(e, own[:-1]), n)
        z = np.add.reduceat(a[:, None] * h, own[:-1], axis=0)
        return h, t, g, a, z, z @ p["c"] + p["d"]

    def _gradients(self, x: np.ndarray, own: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.params, np.diff(own)
        h, t, g, a, z, raw = self._forward(x, own)
        ds = (1 / (1 + np.exp(-raw)) - y) / len(y)
        dz = np.repeat(ds, n)[:, None] * p["c"]
        da = (h * dz).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, own[:-1]), n))
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (h > 0)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ ds, "d": ds.sum()}

    def score(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._forward(self._scaled(x), bounds)[-1].astype(np.float64), -60, 60)))

    def attention(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Weight of each passage within its document."""
        return self._forward(self._scaled(x), bounds)[3]


TRAINING_ROWS = 8_000


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAINING_ROWS, model: AttentionModel | None = None) -> AttentionModel:
    """Fit on a bounded sample: at most ``most`` labelled documents, whatever the size of the corpus.

    Executors encode the passages; the driver gets these and the labels, in the order of doc_id. Without
    any labelled row every text gets 0.5, the smoothed share.
    """

    def encode(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                x, bounds = encode_passages(data, offsets[i : j + 1])
                rows = [x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, pa.binary()), batch.column(2).slice(i, j - i)], names=["doc_id", "x", "y"])

    rows = training_rows(docs, labels, label, most)
    rows = rows.mapInArrow(encode, f"doc_id {dict(docs.dtypes)['doc_id']}, x binary, y int").toArrow().sort_by("doc_id")
    found = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in rows["x"].to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
    return (model or AttentionModel()).fit(np.concatenate([*found, np.zeros((0, WIDTH), np.float32)]), bounds, rows["y"].to_numpy().astype(np.float64))


def score(docs: DataFrame, model: AttentionModel, out: str = "score") -> DataFrame:
    """Adds ``out`` to every row, in place of a column of that name; whole texts, null texts are empty (one passage without words).

    Rows that repeat are scored each, equal texts alike; other columns pass through. An empty table gives no rows. No shuffle; the model is a few kB.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop(out)
    names = docs.columns

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets):
                scores = model.score(*encode_passages(data, offsets[i : j + 1]))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in names], pa.array(scores, pa.float64())], names=[*names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


@query("op10_quality")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = fit(docs, table(spark, folder, "labels").where(~held_out(0, 5)))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(0, 5).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: the rows that the classifier does not reject, whole.

    Null and empty texts are scored as one empty passage, long ones in all their passages. Equal texts fare alike, repeated
    rows stay repeated, other columns may have any name, and an empty table stays empty.
    """
    model = fit(docs, table(spark, folder, "labels").where(~held_out(0, 5)))
    rows, back = packed(docs, ("doc_id", "text"))
    return score(rows, model, "__quality").where("__quality >= 0.3").select(*back)
