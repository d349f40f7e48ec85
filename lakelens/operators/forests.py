"""Forests of binned features that Spark tasks grow level by level, for steps that need many forests of many rows.

The rules are those of Spark's forests: bins at midpoints of distinct values or at even shares of a sample, Poisson bags, a
random third (numbers) or root (classes) of the slots for each node, the split with the largest fall in variance or
Gini impurity, and importances by that fall. Rows are binned once and written in runs (one byte for each slot where bins
allow it). A level is one pass: tasks add up sums by node, slot and bin for all trees, and tasks that own some nodes of a
tree add these up and choose splits; only the chosen splits reach the driver.
"""

from __future__ import annotations

import base64
import io
import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.functions.columns import col
from lakelens.plans.matrix import as_array, stack
from lakelens.plans.session import cut, forget

SAMPLE = 10_000  # rows, at least, from which the bins of numbers are taken
RUN = 65_536  # rows of a run, at most
HELD = 1 << 23  # sums that a task holds in a pass, at most (64 MB); trees are grown in several passes beyond it
OWNED = 1 << 13  # sums of the nodes that are added up together
DIRECT = 1 << 22  # sums of all tasks (32 MB), at most, that the driver adds up itself, without a shuffle
SUBSETS = 6  # categories, at most, of which all subsets are tried where there are more than two classes


# ---------------------------------------------------------------- bins


def arities(df: DataFrame, features: str) -> dict[int, int]:
    """Number of categories of the slots that the vector's metadata names as nominal."""
    attrs = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    return {a["idx"]: len(a["vals"]) for a in attrs.get("nominal", []) if "vals" in a}


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    v = v[~np.isnan(v)]
    u, n = np.unique(v, return_counts=True)
    mid = u[:-1] + (u[1:] - u[:-1]) / 2
    if len(mid) < bins:
        return mid
    at = np.searchsorted(np.cumsum(n), len(v) / bins * np.arange(1, bins))
    return mid[np.unique(np.minimum(at, len(mid) - 1))]


def bin_edges(df: DataFrame, features: str, bins: int, nominal: dict[int, int] | None = None, seed: int = 0) -> list:
    """For each slot its edges (a value at an edge is below it), or the number of its categories."""
    n = df.count()
    want = max(SAMPLE, bins * bins)
    some = df.select(as_array(df, features).alias("x"))
    some = some if n <= want else some.sample(min(1.0, 1.1 * want / n), seed)
    x = stack(some.toPandas()["x"])
    return [(nominal or {}).get(j, None) or _edges(x[:, j], bins) for j in range(x.shape[1])]


def binned(x: np.ndarray, edges: list, kind) -> np.ndarray:
    out = np.empty(x.shape, kind)
    for j, e in enumerate(edges):
        if isinstance(e, int):  # the bin behind the last category holds what was not seen
            code = np.nan_to_num(x[:, j], nan=e)
            out[:, j] = np.where((code >= 0) & (code < e), code, e)
        else:
            out[:, j] = np.searchsorted(e, x[:, j])
    return out


def _width(edges: list) -> int:
    return max(2, *(e + 1 if isinstance(e, int) else len(e) + 1 for e in edges))


def _kind(edges: list):
    return np.uint8 if _width(edges) <= 256 else np.uint16 if _width(edges) <= 65_536 else np.uint32


def packed(df: DataFrame, features: str, label: str, edges: list) -> DataFrame:
    """(run, n, s, ss, x, y): binned rows in runs of at most RUN, with the sums of the label; written once."""
    kind = _kind(edges)

    def pack(batches):
        task, k, xs, ys = TaskContext.get().partitionId(), 0, [], []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                xs.append(binned(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1), edges, kind))
                ys.append(y)
            if ys and (batch is None or sum(map(len, ys)) >= RUN):
                x, y = np.concatenate(xs), np.concatenate(ys)
                for at in range(0, len(y), RUN):
                    part = y[at : at + RUN]
                    yield pa.RecordBatch.from_pydict({"run": [(task << 24) + k], "n": [len(part)], "s": [float(part.sum())], "ss": [float((part * part).sum())], "x": [x[at : at + RUN].tobytes()], "y": [part.tobytes()]})
                    k += 1
                xs, ys = [], []

    rows = df.select(as_array(df, features).alias("x"), col(label).cast("double").alias("y"))
    return cut(rows.mapInArrow(pack, "run long, n long, s double, ss double, x binary, y binary"))


# ---------------------------------------------------------------- trees


@dataclass
class Trees:
    """Trees as heaps: slot of each node (-1: leaf), the bins that go left, its value (mean, or rows by class), and the fall in impurity times rows."""

    edges: list
    slot: np.ndarray
    left: np.ndarray
    value: np.ndarray
    fall: np.ndarray

    def importances(self) -> np.ndarray:
        """Sums of falls by slot, each tree's as shares; they add up to one."""
        p, total = len(self.edges), np.zeros(len(self.edges))
        for slot, fall in zip(self.slot, self.fall):
            own = np.bincount(slot[slot >= 0], fall[slot >= 0], minlength=p)
            total += own / own.sum() if own.sum() > 0 else 0
        return total / total.sum() if total.sum() > 0 else total

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean of the trees' values (classes: shares), rows x (1 or classes)."""
        p, width = x.shape[1], self.left.shape[2]
        flat, base = binned(x, self.edges, _kind(self.edges)).ravel(), np.arange(len(x)) * p
        out = np.zeros((len(x), self.value.shape[2]))
        for slot, left, value in zip(self.slot, self.left, self.value):
            at, go = np.zeros(len(x), int), left.ravel()
            while True:
                s = slot[at]
                inner = s >= 0
                if not inner.any():
                    break
                below = 2 * at + 2 - go[at * width + flat[base + np.maximum(s, 0)]]
                at = np.where(inner, below, at)
            got = value[at]
            out += got / np.maximum(got.sum(axis=1, keepdims=True), 1e-300) if out.shape[1] > 1 else got
        return out / len(self.slot)


def _poisson(rate: float) -> np.ndarray:
    """Number of copies for each 16-bit draw."""
    share, k, total = math.exp(-rate), 0, 0.0
    ends = []
    while total < 1 - 2**-17 and k < 30:
        total += share
        ends.append(total)
        k += 1
        share *= rate / k
    return np.searchsorted(np.array(ends), (np.arange(65_536) + 0.5) / 65_536).astype(np.uint8)


def _orders(h: np.ndarray, arity: int, classes: int):
    """Orders of the bins of a nominal slot (their beginnings are the left sets), for one node: by mean, by share of a class, or all subsets."""
    w = h.sum(axis=1) if classes else h[:, 0]
    some = np.where(w > 0, w, 1.0)
    if classes <= 2:
        yield np.argsort(np.where(w > 0, h[:, 1] / some, np.inf), kind="stable"), None
        return
    seen = np.flatnonzero(w > 0)
    if arity <= SUBSETS:
        for size in range(1, len(seen) // 2 + 1):
            for part in itertools.combinations(seen, size):
                rest = np.setdiff1d(np.arange(len(w)), part)
                yield np.concatenate([part, rest]).astype(int), size - 1
        return
    for k in range(classes):
        yield np.argsort(np.where(w > 0, h[:, k] / some, np.inf), kind="stable"), None


def _best(h: np.ndarray, slots: np.ndarray, edges: list, classes: int, least: float):
    """(slot, left bins, fall, sums left) of the best split of one node, or None; ``h`` is slots x bins x sums."""
    total = h[0].sum(axis=0)
    size = lambda c: c.sum(axis=-1) if classes else c[..., 0]
    square = lambda c: (c * c).sum(axis=-1) if classes else c[..., 1] ** 2
    best = None
    for j, s in enumerate(slots):
        nominal = isinstance(edges[s], int)
        for order, only in _orders(h[j], edges[s], classes) if nominal else [(np.arange(h.shape[1]), None)]:
            low = np.cumsum(h[j][order], axis=0)[:-1]
            high = total - low
            a, b = size(low), size(high)
            ok = (a >= 1) & (b >= 1)
            if only is not None:
                ok &= np.arange(len(ok)) == only
            if not ok.any():
                continue
            fall = np.where(ok, square(low) / np.where(ok, a, 1) + square(high) / np.where(ok, b, 1), -np.inf) - square(total) / size(total)
            i = int(fall.argmax())
            if fall[i] > least * size(total) and (best is None or fall[i] > best[2]):
                left = np.zeros(h.shape[1], bool)
                left[order[: i + 1]] = True
                if nominal:
                    left &= h[j].sum(axis=1) > 0 if classes else h[j][:, 0] > 0  # categories without rows go right
                best = (int(s), left, float(fall[i]), low[i])
    return total, best


def grow(data: DataFrame, edges: list, trees: int, depth: int, classes: int = 0, rate: float = 1.0, bootstrap: bool = True, seed: int = 0) -> Trees:
    """Trees on ``packed`` rows; ``classes``: number of classes, 0 for numbers."""
    p, width, kind, sums = len(edges), _width(edges), _kind(edges), classes or 2
    n, s, ss = data.agg(F.sum("n"), F.sum("s"), F.sum("ss")).first()
    mean = 0.0 if classes or not n else s / n
    least = 1e-12 if classes else 1e-12 * max(ss / n - mean * mean, 0.0) if n else 0.0
    some = max(1, math.ceil(math.sqrt(p) if classes else p / 3)) if trees > 1 else p
    nodes = 2 ** (depth + 1) - 1
    slot, left = np.full((trees, nodes), -1, np.int32), np.zeros((trees, nodes, width), bool)
    value, fall = np.zeros((trees, nodes, classes or 1)), np.zeros((trees, nodes))
    bag, tasks = _poisson(rate) if bootstrap else np.ones(65_536, np.uint8), data.rdd.getNumPartitions()
    worth = lambda c: c if classes else np.array([mean + c[1] / c[0]]) if c[0] else np.array([0.0])
    rng, open_ = np.random.default_rng(seed), {t: [0] for t in range(trees)}
    for level in range(depth):
        todo = [t for t in range(trees) if open_[t]]
        picks = {t: rng.random((len(open_[t]), p)).argsort(axis=1)[:, :some] for t in todo}
        after = {t: [] for t in range(trees)}
        while todo:
            part, held = [], 0
            while todo and (not part or held + len(open_[todo[0]]) * some * width * sums <= HELD):
                held += len(open_[todo[0]]) * some * width * sums
                part.append(todo.pop(0))
            for t, node, size, found in _level(data, edges, level, {t: (open_[t], picks[t], slot[t], left[t]) for t in part}, p, width, kind, classes, bag, seed, mean, least, held * tasks <= DIRECT):
                value[t, node] = worth(size)
                if found is None:
                    continue
                slot[t, node], left[t, node], fall[t, node], low = found
                value[t, 2 * node + 1], value[t, 2 * node + 2] = worth(low), worth(size - low)
                after[t] += [2 * node + 1, 2 * node + 2]
        open_ = {t: sorted(v) for t, v in after.items()}
    said = value.argmax(axis=2) if classes else value[:, :, 0]
    for node in reversed(range(2**depth - 1)):  # leaves that say the same as their sibling are one leaf
        a, b = 2 * node + 1, 2 * node + 2
        alike = (slot[:, node] >= 0) & (slot[:, a] < 0) & (slot[:, b] < 0) & (said[:, a] == said[:, b])
        slot[alike, node], left[alike, node], fall[alike, node] = -1, False, 0.0
    return Trees(edges, slot, left, value, fall)


def _level(data, edges, level, state, p, width, kind, classes, bag, seed, mean, least, direct):
    """Splits of the open nodes of some trees: (tree, node, sums, split or None), from one pass over the rows."""
    sums, first = classes or 2, 2**level - 1
    own = max(1, OWNED // (next(iter(state.values()))[1].shape[1] * width * sums))  # nodes that are added up together

    def add(batches):
        total = {t: np.zeros((len(v[0]), v[1].shape[1], width, sums)) for t, v in state.items()}
        for batch in batches:
            for run, x, y in zip(*(batch.column(c) for c in ("run", "x", "y"))):
                x, y = np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer())
                y = y.astype(int) if classes else y - mean
                for t, (nodes, picks, slot, left) in state.items():
                    w = bag[np.random.default_rng([seed, t, run.as_py()]).integers(0, 65_536, len(y), np.uint16)]
                    rows = np.flatnonzero(w)
                    at, go = np.zeros(len(rows), np.int64), left.ravel()
                    for _ in range(level):
                        s = slot[at]
                        if (slot[: 2 * first + 1][at] < 0).any():
                            inner = s >= 0
                            rows, at, s = rows[inner], at[inner], s[inner]
                        at = 2 * at + 2 - go[at * width + x[rows * p + s]]
                    place = np.full(first + 1, -1)
                    place[np.array(nodes) - first] = np.arange(len(nodes))
                    at = place[at - first]
                    if len(nodes) <= first and (at < 0).any():
                        rows, at = rows[at >= 0], at[at >= 0]
                    weight, base, out = w[rows].astype(float), rows * p, total[t]
                    yw = None if classes else weight * y[rows]
                    for j in range(picks.shape[1]):
                        key = at * width + x[base + picks[:, j][at]]
                        if classes:
                            out[:, j] += np.bincount(key * classes + y[rows], weight, minlength=len(nodes) * width * classes).reshape(len(nodes), width, classes)
                        else:
                            out[:, j, :, 0] += np.bincount(key, weight, minlength=len(nodes) * width).reshape(len(nodes), width)
                            out[:, j, :, 1] += np.bincount(key, yw, minlength=len(nodes) * width).reshape(len(nodes), width)
        for t, h in total.items():
            parts = range(0, len(h), own)
            yield pa.RecordBatch.from_pydict({"t": pa.array([t] * len(parts), pa.int32()), "k": pa.array(list(parts), pa.int32()), "h": [h[k : k + own].tobytes() for k in parts]})

    def choose(key, table):
        t, k, total = key[0].as_py(), key[1].as_py(), 0.0
        for h in table.column("h"):
            total = total + np.frombuffer(h.as_buffer())
        return chosen(t, k, total)

    def chosen(t, k, total):
        nodes, picks, _, _ = state[t]
        total = total.reshape(-1, picks.shape[1], width, sums)
        out = []
        for i, h in enumerate(total):
            size, best = _best(h, picks[k + i], edges, classes, least)
            s, left, fall, low = best or (-1, np.zeros(0, bool), 0.0, np.zeros(0))
            out.append((t, nodes[k + i], size.tolist(), s, left.tobytes(), fall, low.tolist()))
        names = ["t", "node", "size", "s", "left", "fall", "low"]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int32(), pa.binary(), pa.float64(), pa.list_(pa.float64())]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=names)

    parts = data.select("run", "x", "y").mapInArrow(add, "t int, k int, h binary")
    if direct:
        total = {}
        for t, k, h in parts.collect():
            total[t, k] = total.get((t, k), 0.0) + np.frombuffer(h)
        found = [r for (t, k), h in total.items() for r in chosen(t, k, h).to_pylist()]
    else:
        found = parts.groupBy("t", "k").applyInArrow(choose, "t int, node int, size array<double>, s int, left binary, fall double, low array<double>").collect()
    for r in sorted(found, key=lambda r: (r["t"], r["node"])):
        yield r["t"], r["node"], np.array(r["size"]), None if r["s"] < 0 else (r["s"], np.frombuffer(r["left"], bool), r["fall"], np.array(r["low"]))


def fit(df: DataFrame, features: str, label: str, trees: int, depth: int, bins: int = 32, classes: int = 0, edges: list | None = None, **how) -> Trees:
    """Bin the rows, write them once, and grow trees on them."""
    edges = edges or bin_edges(df, features, bins, arities(df, features))
    data = packed(df, features, label, edges)
    out = grow(data, edges, trees, depth, classes, **how)
    forget(data)
    return out


class GrownForest(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, DefaultParamsReadable, DefaultParamsWritable):
    """A forest as an ML model: a number, or a class and the shares of the classes."""

    trees = Param(Params._dummy(), "trees", "the trees, as text", typeConverter=TypeConverters.toString)

    @classmethod
    def of(cls, trees: Trees, **params):
        held = io.BytesIO()
        lengths = np.array([e if isinstance(e, int) else -len(e) - 1 for e in trees.edges])
        flat = np.concatenate([np.zeros(0), *[e for e in trees.edges if not isinstance(e, int)]])
        np.savez_compressed(held, lengths=lengths, flat=flat, slot=trees.slot, left=np.packbits(trees.left, axis=2), width=trees.left.shape[2], value=trees.value, fall=trees.fall)
        return cls()._set(trees=base64.b64encode(held.getvalue()).decode(), **params)

    def grown(self) -> Trees:
        with np.load(io.BytesIO(base64.b64decode(self.getOrDefault(self.trees)))) as f:
            edges, at = [], 0
            for n in f["lengths"].tolist():
                edges.append(n if n >= 0 else f["flat"][at : at - n - 1])
                at += max(0, -n - 1)
            left = np.unpackbits(f["left"], axis=2, count=int(f["width"])).astype(bool)
            return Trees(edges, f["slot"], left, f["value"], f["fall"])

    def _transform(self, df):
        held = []
        text = self.getOrDefault(self.trees)

        @F.pandas_udf("array<double>")
        def score(v: pd.Series) -> pd.Series:
            if not held:
                held.append(GrownForest()._set(trees=text).grown())
            return pd.Series(list(held[0].predict(stack(v))) if len(v) else [], dtype=object)

        made = score(as_array(df, self.getFeaturesCol()))
        if self.grown().value.shape[2] == 1:
            return df.withColumn(self.getPredictionCol(), made[0])
        df = df.withColumn("__shares", made)
        best = F.array_position("__shares", F.array_max("__shares")) - 1
        return df.withColumns({self.getPredictionCol(): best.cast("double"), self.getProbabilityCol(): array_to_vector("__shares")}).drop("__shares")
