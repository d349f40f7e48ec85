"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.base import bounded_batches, documents, query, slices, utf8
from lakelens.llm.terms import distinct_terms, segment_sums
from lakelens.sources.io import table


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum w_i + 1/n * sum_{i<j} <v_i, v_j>) over the n known terms of a text.

    Terms are words and word beginnings hashed to 2**bits numbers. Known are all in at least ``least`` training
    texts, also those that say nothing alone: the pair sum learns what two terms mean together, beyond their weights.
    Weights and factors have normal priors, once for the whole of the training texts, so that rare terms cannot
    remember their texts. The variances are ``spread_w`` and ``spread_v`` for terms whose own share of label 1 is off by
    ``telling`` standard errors or more, and ``quiet_w`` and ``quiet_v`` for all others: those hardly speak
    alone, but their factors stay free to find partners.
    """

    bits: int = 18
    factors: int = 8
    least: int = 4
    telling: float = 3.0
    spread_w: float = 10.0
    spread_v: float = 20.0
    quiet_w: float = 1e-3
    quiet_v: float = 0.3
    epochs: int = 10
    batch: int = 128
    rate: float = 0.1
    seed: int = 7

    def fit(self, terms: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> FactorizationMachine:
        rng, size = np.random.default_rng(self.seed), 1 << self.bits
        often = np.bincount(terms, minlength=size)
        self.known, prior = often >= self.least, (1 / np.maximum(often, 1)).astype(np.float32)
        share = (labels.sum() + 1) / (len(labels) + 2)
        off = np.abs(np.bincount(terms, np.repeat(labels, np.diff(bounds)), size) - often * share)
        z = off / np.sqrt(np.maximum(often, 1) * share * (1 - share))
        tight_w = (1 / np.where(z >= self.telling, self.spread_w, self.quiet_w)).astype(np.float32)
        tight_v = (1 / np.where(z >= self.telling, self.spread_v, self.quiet_v)).astype(np.float32)
        self.w, self.bias = np.zeros(size, np.float32), float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
        self.v = np.where(self.known[:, None], rng.normal(0, 0.05, (size, self.factors)), 0).astype(np.float32)
        seen_w, seen_v, seen_b = np.full(size, 1e-2, np.float32), np.full((size, self.factors), 1e-2, np.float32), 1e-2
        for _ in range(self.epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), self.batch):
                pick = order[at : at + self.batch]
                rows = [terms[bounds[i] : bounds[i + 1]] for i in pick]
                rows = [r[self.known[r]] for r in rows]
                ids = np.concatenate(rows)
                n = np.array([len(r) for r in rows])
                own = np.concatenate([[0], np.cumsum(n)])
                raw, sums = self._raw(ids, own)
                error = 1 / (1 + np.exp(-raw)) - labels[pick]
                per_term = np.repeat(error, n).astype(np.float32)
                pair = (np.repeat(error / np.maximum(n, 1), n).astype(np.float32))[:, None] * (np.repeat(sums, n, axis=0) - self.v[ids])
                terms_here, place, times = np.unique(ids, return_inverse=True, return_counts=True)
                part = prior[terms_here] * times  # of the prior that falls to this batch
                gw = np.bincount(place, per_term, len(terms_here)).astype(np.float32) + part * tight_w[terms_here] * self.w[terms_here]
                order_here = np.argsort(place, kind="stable")
                gv = segment_sums(pair[order_here], np.append(0, np.cumsum(times))) + (part * tight_v[terms_here])[:, None] * self.v[terms_here]
                seen_w[terms_here] += gw * gw
                seen_v[terms_here] += gv * gv
                self.w[terms_here] -= self.rate * gw / np.sqrt(seen_w[terms_here])
                self.v[terms_here] -= self.rate * gv / np.sqrt(seen_v[terms_here])
                g = float(error.sum())
                seen_b += g * g
                self.bias -= self.rate * g / np.sqrt(seen_b)
        return self

    def _raw(self, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = self.v[ids]
        sums = segment_sums(v, own)
        pairs = ((sums * sums).sum(1) - segment_sums((v * v).sum(1), own)) / 2
        return self.bias + segment_sums(self.w[ids], own) + pairs / np.maximum(np.diff(own), 1), sums

    def score(self, terms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        keep = self.known[terms]
        own = np.concatenate([[0], np.cumsum(keep)])[bounds]
        return 1 / (1 + np.exp(-np.clip(self._raw(terms[keep], own)[0].astype(np.float64), -60, 60)))


def held_out(remainder: int, modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == remainder


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled documents: those whose ids have the smallest hashes.

    Rows with a null id, label or text are left out, and ids with two different labels. Of rows that repeat an
    id only the text with the smallest hash counts, however many there are.
    """
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("top"))
    y = y.where("y = top").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.col("y").cast("int").alias("y"))
    picked = docs.where(F.col("text").isNotNull()).join(F.broadcast(y), "doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("f")
    return picked.groupBy("doc_id", "y").agg(first).select("doc_id", "f.text", "y")  # at most `most` rows


TRAINING_ROWS = 16_000


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAINING_ROWS, model: FactorizationMachine | None = None) -> FactorizationMachine:
    """Fit on a bounded sample: at most ``most`` labelled documents, whatever the size of the corpus.

    Executors turn the texts into distinct term numbers; the driver gets these and the labels, in the order of doc_id.
    Without any labelled row, or with one label only, the model gives every text the smoothed share of label 1.
    """
    model = model or FactorizationMachine()

    def terms(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                found, bounds = distinct_terms(data, offsets[i : j + 1], model.bits)
                rows = [found[a:b].astype(np.int32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, pa.binary()), batch.column(2).slice(i, j - i)], names=["doc_id", "terms", "y"])

    rows = training_rows(docs, labels, label, most)
    rows = rows.mapInArrow(terms, f"doc_id {dict(docs.dtypes)['doc_id']}, terms binary, y int").toArrow().sort_by("doc_id")
    found = [np.frombuffer(t, np.int32) for t in rows["terms"].to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
    return model.fit(np.concatenate([*found, np.zeros(0, np.int32)]).astype(np.int64), bounds, rows["y"].to_numpy().astype(np.float64))


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """(doc_id, score) of every whole text; null and empty texts have no terms and get the bias.

    Texts of any length count whole. Rows that repeat an id are scored each, equal texts alike; ids may be null, other
    columns are ignored, and an empty table gives no rows.
    The model is one array of 2**bits weights and factors (9 MB), sent to the tasks as a broadcast; there is no shuffle.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                scores = shared.value.score(*distinct_terms(data, offsets[i : j + 1], shared.value.bits))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


@query("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = fit(docs, table(spark, folder, "labels").where(~held_out(1, 3)))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(1, 3).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
