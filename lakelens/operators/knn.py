"""Exact nearest-neighbour and radius joins without a cross join.

Rows are placed in Voronoi cells of a bounded set of pivots. The triangle inequality gives, for every
query cell, a bound on the distance that its k-th neighbour can have, so a data row is sent only to the
cells whose queries it may serve (after Lu et al., "Efficient processing of k nearest neighbor joins
using MapReduce", 2012). Neighbouring cells share a bundle, and bundles are cut into blocks of a bounded size
on both sides: a row is shuffled once for each block of the other side, and each block merges what it
finds in tiles of BLOCK x BLOCK rows. So no task depends on the size of a cell, and blocks return only the
best k rows (or counts), never pairs.

Equal vectors are merged first: a query vector is answered once for all its copies, and among the copies
in the data only the k + 1 smallest ids can ever be neighbours.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelens.functions.columns import col
from lakelens.plans.matrix import as_array, stack
from lakelens.plans.session import BROADCAST_VECTORS, cut, lookup

BLOCK = 2048  # rows of a tile, for which a matrix of distances is made
NUMBERS = 1 << 22  # numbers of the vectors on one side of a block, at most (32 MB as doubles)
MAX_PIVOTS = 1000
CELL_TARGET = 4000


def distances(x: np.ndarray, y: np.ndarray, p: int = 2) -> np.ndarray:
    """len(x) x len(y) matrix of exact differences (no dot-product cancellation)."""
    out = np.empty((len(x), len(y)))
    for i, row in enumerate(x):
        d = y - row
        out[i] = np.sqrt(np.einsum("ij,ij->i", d, d)) if p == 2 else np.abs(d).sum(axis=1)
    return out


def pair_distances(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, p: int = 2) -> np.ndarray:
    """Distances of the pairs (x[i], y[j]), digit for digit those of :func:`distances`."""
    out = np.empty(len(i))
    for at in range(0, len(i), 65_536):
        part = slice(at, at + 65_536)
        d = y[j[part]] - x[i[part]]
        out[part] = np.sqrt(np.einsum("ij,ij->i", d, d)) if p == 2 else np.abs(d).sum(axis=1)
    return out


def rough(x: np.ndarray, y: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(len(x) x len(y) matrix, bound on its error by row): squared distances by one matrix product (p = 2), or sums of differences in single precision.

    Only pairs that this bound leaves in doubt need their exact distance.
    """
    dims = x.shape[1]
    if p == 2:
        xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
        d = x @ y.T
        d *= -2.0
        d += xx[:, None]
        d += yy
        return d, (4 * dims + 32) * np.finfo(float).eps * (xx + yy.max())
    ax, ay = np.abs(x).sum(axis=1), np.abs(y).sum(axis=1).max()
    kind = np.float32 if max(ax.max(), ay) < 1e30 else np.float64
    d, columns, gap = np.empty((len(x), len(y)), kind), np.ascontiguousarray(y.T, kind), np.empty((dims, len(y)), kind)
    for i, row in enumerate(x.astype(kind)):
        np.subtract(columns, row[:, None], out=gap)
        np.abs(gap, out=gap)
        np.add.reduce(gap, axis=0, out=d[i])
    return d, (2 * dims + 16) * np.finfo(kind).eps * (ax + ay) + 1e-36 * dims


def within(x: np.ndarray, y: np.ndarray, eps: float, p: int = 2) -> np.ndarray:
    """Boolean matrix of the pairs whose exact distance is at most ``eps``."""
    d, error = rough(x, y, p)
    d -= eps * eps if p == 2 else eps
    near = d < 0
    i, j = np.nonzero(~(np.abs(d, out=d) > error[:, None]))
    near[i, j] = pair_distances(x, y, i, j, p) <= eps
    return near


def nearest(x: np.ndarray, y: np.ndarray, k: int, p: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(places in y, exact distances), len(x) x k: the k nearest rows of y by distance, then place."""
    d, error = rough(x, y, p)
    edge = np.partition(d, k - 1, axis=1)[:, k - 1] + 2 * error
    i, j = np.nonzero(~(d > edge[:, None]))  # at least k of every row
    return _first(len(x), k, i, j, pair_distances(x, y, i, j, p))


def _first(n: int, k: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(j, d), n x k: the first k of the candidates of every row i, by distance, then place; at least k each."""
    order = np.lexsort((j, d, i))
    first = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=n))[:-1]])
    pick = order[first[:, None] + np.arange(k)]
    return j[pick], d[pick]


def nearest_by_tiles(x: np.ndarray, y: np.ndarray, k: int, p: int = 2, tile: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`nearest` returns, in tiles of y: behind the first, only pairs that may beat the k-th so far are looked at."""
    start = max(tile, k)
    at, best = nearest(x, y[:start], k, p)
    rows = np.repeat(np.arange(len(x)), k)
    for start in range(start, len(y), tile):
        part = y[start : start + tile]
        d, error = rough(x, part, p)
        edge = (best[:, -1] ** 2 if p == 2 else best[:, -1]) + 2 * error
        i, j = np.nonzero(~(d > edge[:, None]))
        if len(i):
            exact = pair_distances(x, part, i, j, p)
            at, best = _first(len(x), k, np.concatenate([rows, i]), np.concatenate([at.ravel(), j + start]), np.concatenate([best.ravel(), exact]))
    return at, best


def dense(values: pd.Series) -> np.ndarray:
    """Matrix of doubles; vectors of floats travel as floats."""
    return stack(values).astype(float, copy=False)


def tiles(n: int, size: int) -> list[slice]:
    return [slice(at, min(at + size, n)) for at in range(0, n, size)]


def pick_pivots(vectors: DataFrame, n: int, pivots: int | None = None) -> np.ndarray:
    """Pivots = the first distinct vectors in hash order; their number is bounded by MAX_PIVOTS."""
    want = pivots or max(1, min(MAX_PIVOTS, n // CELL_TARGET))
    rows = vectors.select("v").orderBy(F.xxhash64("v"), "v").limit(want).collect()
    return np.array([r["v"] for r in rows], dtype=float)


def place(df: DataFrame, pivots: np.ndarray, p: int) -> DataFrame:
    """Add the nearest pivot (cell) and the distance to it (dp)."""

    @F.pandas_udf("cell int, dp double")
    def closest(v: pd.Series) -> pd.DataFrame:
        d = distances(dense(v), pivots, p) if len(v) else np.empty((0, len(pivots)))
        best = d.argmin(axis=1) if len(d) else np.empty(0, dtype=int)
        return pd.DataFrame({"cell": best.astype("int32"), "dp": d[np.arange(len(d)), best]})

    return df.withColumn("__c", closest("v")).select("*", "__c.cell", "__c.dp").drop("__c")


def _bundles(counts: np.ndarray, reach: np.ndarray, rows: int) -> np.ndarray:
    """Bundle of every query cell (-1: no queries): each takes the cell that the last one reaches first, while their queries fit ``rows``."""
    left, of, bundle, held = set(np.flatnonzero(counts).tolist()), np.full(len(counts), -1), 0, 0
    cell = min(left, default=None)
    while left:
        left.remove(cell)
        if held and held + counts[cell] > rows:
            bundle, held = bundle + 1, 0
        of[cell], held = bundle, held + counts[cell]
        near = np.fromiter(left, int, len(left))
        cell = int(near[reach[cell, near].argmin()]) if left else None
    return of


def run_blocks(queries: DataFrame, data: DataFrame, fn, schema: str, dims: int, reach: np.ndarray | None = None, block: int = BLOCK) -> DataFrame:
    """Meet queries (qid, v, cell) and data (id, v, cell, dp) in blocks; fn(query frame, vectors, data frame, vectors) -> frame.

    A data row meets the queries of a cell where dp >= reach[own cell, query cell]; without ``reach`` there is one cell and
    it meets all. A block holds the queries of a bundle of cells and the data rows that any of them reaches, and fn is
    called once for each cell in it. Bundles are split on both sides by the hash of the row, into blocks of at most NUMBERS
    numbers (``block`` rows at least), and smaller ones as long as there are less than four for each core.
    A row is shuffled once for each block of the other side, so the shuffle grows with rows x blocks.
    """
    spark, table = queries.sparkSession, np.zeros((1, 1)) if reach is None else reach
    counts = np.zeros(len(table), dtype=int)
    for cell, n in queries.groupBy("cell").agg(F.count("*")).collect():  # one row per pivot cell: at most MAX_PIVOTS
        counts[cell] = n
    cores = math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism))
    size = lambda n: min(max(block, NUMBERS // max(1, dims)), max(block, math.ceil(n / cores)))
    of = _bundles(counts, table, size(counts.sum()))
    k = int(of.max()) + 1
    low = np.full((len(table), max(1, k)), np.inf)  # a data row of a cell goes to a bundle from this dp on
    for b in range(k):
        low[:, b] = np.min(table[:, of == b], axis=1)

    @F.pandas_udf("array<int>")
    def targets(cell: pd.Series, dp: pd.Series) -> pd.Series:
        hit = dp.to_numpy()[:, None] >= low[cell.to_numpy(dtype=int)]
        return pd.Series([np.flatnonzero(h).astype("int32") for h in hit], dtype=object)

    to = F.sequence(F.lit(0), F.lit(k - 1)) if reach is None else targets("cell", "dp")
    sent = data.withColumn("__b", F.explode(to)) if k else data.withColumn("__b", F.lit(0)).limit(0)
    whole = np.bincount(of[of >= 0], counts[of >= 0], minlength=k)
    met = dict(sent.groupBy("__b").agg(F.count("*")).collect())
    most = size(max(met.values(), default=0))
    plan = [(b, math.ceil(whole[b] / size(counts.sum())), math.ceil(met[b] / most)) for b in range(k) if b in met]
    plan = F.broadcast(spark.createDataFrame(plan, "__b int, __nq int, __nd int"))
    bundle = F.get(F.array(*[F.lit(int(b)) for b in of]), "cell")
    part = lambda key, n: F.pmod(F.xxhash64(key, "v"), F.col(n)).cast("int")
    q = queries.withColumn("__b", bundle).join(plan, "__b").withColumn("__q", part("qid", "__nq")).withColumn("__d", F.explode(F.sequence(F.lit(0), F.col("__nd") - 1)))
    # fresh column ids: both sides may come from the same rows
    d = sent.select([F.col(c).alias(c) for c in sent.columns]).join(plan, "__b")
    d = d.withColumn("__d", part("id", "__nd")).withColumn("__q", F.explode(F.sequence(F.lit(0), F.col("__nq") - 1)))
    keys = ["__b", "__q", "__d"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame()
        x, y = dense(left.pop("v")), dense(right.pop("v"))
        if reach is None:
            return fn(left, x, right, y)
        out, own, dp = [], right["cell"].to_numpy(), right["dp"].to_numpy()
        for cell, at in left.groupby("cell").indices.items():
            met = np.flatnonzero(dp >= reach[own, cell])
            if len(met):
                out.append(fn(left.iloc[at], x[at], right.iloc[met], y[met]))
        out = [f for f in out if len(f)]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame()

    return q.drop("__nq", "__nd").groupBy(*keys).cogroup(d.drop("__nq", "__nd").groupBy(*keys)).applyInPandas(run, schema)


def knn_vectors(queries: DataFrame, data: DataFrame, k: int, p: int = 2, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """(qid, id, distance, rank): the k nearest data rows (ties: smaller id) of each distinct query vector.

    ``queries`` has (qid, v) with distinct v; ``data`` has (id, v) with at most k copies per vector.
    """
    n = data.count()
    centres = pick_pivots(data, n, pivots)
    q, s = place(queries, centres, p).persist(), place(data, centres, p).persist()
    gap = distances(centres, centres, p)
    radius = np.zeros(len(centres))
    for cell, u in q.groupBy("cell").agg(F.max("dp")).collect():
        radius[cell] = u
    # the k smallest pivot distances of every data cell bound the k-th neighbour of every query cell
    w = Window.partitionBy("cell").orderBy("dp")
    near = s.select("cell", "dp").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).collect()
    cells, dps = np.array([v["cell"] for v in near], dtype=int), np.array([v["dp"] for v in near])
    reach = np.full((len(centres), len(centres)), -np.inf)
    if len(dps) >= k:
        for i in range(len(centres)):
            theta = np.partition(radius[i] + gap[i, cells] + dps, k - 1)[k - 1]
            reach[:, i] = (gap[i] - radius[i] - theta) - 1e-9 * (1 + theta + gap[i])

    def best(left: pd.DataFrame, x: np.ndarray, right: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
        ids = right["id"].reset_index(drop=True).sort_values()
        ids, y, m = ids.to_numpy(), y[ids.index], min(k, len(ids))
        found = [nearest_by_tiles(x[t], y, m, p, block) for t in tiles(len(x), block)]
        at, d = (np.concatenate(f) for f in zip(*found))
        return pd.DataFrame({"qid": np.repeat(left["qid"].to_numpy(), m), "id": ids[at.ravel()], "distance": d.ravel()})

    id_type = dict(data.dtypes)["id"]
    found = run_blocks(q.select("qid", "v", "cell"), s.select("id", "v", "cell", "dp"), best, f"qid {dict(queries.dtypes)['qid']}, id {id_type}, distance double", centres.shape[-1], reach, block)
    rank = Window.partitionBy("qid").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def vectors(df: DataFrame, id_col: str, features: str) -> DataFrame:
    """(id, v): arrays of floats as they are, others as doubles."""
    narrow = dict(df.dtypes)[features] == "array<float>"
    return df.select(col(id_col).alias("id"), (col(features) if narrow else as_array(df, features)).alias("v"))


def knn_join(
    queries: DataFrame, data: DataFrame, id_col: str, features: str, k: int, p: int = 2, pivots: int | None = None, block: int = BLOCK
) -> DataFrame:
    """(id, rank, neighbour, distance): k nearest rows of ``data`` for every row of ``queries``.

    Passing the same frame twice gives the self join, in which a row is not its own neighbour.
    """
    same = queries is data
    k1 = k + 1 if same else k
    s = cut(vectors(data, id_col, features))
    copies = Window.partitionBy("v").orderBy("id")
    # row_number <= k1 is limited on the map side, so a vector with very many copies stays cheap
    kept = s.withColumn("c", F.row_number().over(copies)).where(F.col("c") <= k1).drop("c")
    q = s if same else cut(vectors(queries, id_col, features))
    distinct = q.groupBy("v").agg(F.min("id").alias("qid"), F.count("*").alias("n"))
    distinct = cut(distinct)
    near = knn_vectors(distinct.select("qid", "v"), cut(kept), k1, p, pivots, block)
    lists = near.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("near"))  # k1 entries each
    table = distinct.join(lists, "qid").select("v", "n", "near")
    rows = lookup(q, cut(table), "v", "n", BROADCAST_VECTORS)
    own = F.filter("near", lambda e: e["id"] != F.col("id")) if same else F.col("near")
    rows = rows.withColumn("near", F.slice(own, 1, k))
    return rows.select(F.col("id").alias(id_col), F.posexplode("near").alias("i", "e")).select(
        id_col, (F.col("i") + 1).alias("rank"), F.col("e.id").alias("neighbour"), F.col("e.distance").alias("distance")
    )


def knn_predict(train: DataFrame, rows: DataFrame, id_col: str, features: str, label: str, k: int = 5, p: int = 2, task: str = "classification", out: str = "prediction") -> DataFrame:
    """Majority vote (tie: smallest label) or mean of the k nearest training rows: (id, prediction)."""
    near = knn_join(rows, train, id_col, features, k, p)
    labels = train.select(col(id_col).alias("neighbour"), col(label).alias("__y"))
    hits = near.join(labels, "neighbour")
    if task == "regression":
        return hits.groupBy(id_col).agg(F.avg("__y").alias(out))
    votes = hits.groupBy(id_col, "__y").agg(F.count("*").alias("n"))
    return votes.groupBy(id_col).agg(F.min_by("__y", F.struct(-F.col("n"), F.col("__y"))).alias(out))


# ---------------------------------------------------------------- radius join


class RadiusBlocks:
    """Blocks in which every query meets all data rows within ``eps``; used by density clustering.

    Works on distinct vectors (qid = smallest id, m = number of copies).
    """

    def __init__(self, distinct: DataFrame, eps: float, p: int = 2, pivots: int | None = None, block: int = BLOCK):
        self.eps, self.p, self.block = eps, p, block
        n = distinct.count()
        self.centres = pick_pivots(distinct, n, pivots)
        self.rows = cut(place(distinct, self.centres, p))
        gap = distances(self.centres, self.centres, p)
        radius = np.zeros(len(self.centres))
        for cell, u in self.rows.groupBy("cell").agg(F.max("dp")).collect():
            radius[cell] = u
        self.reach = gap - radius[None, :] - eps - 1e-9 * (1 + gap)  # [data cell, query cell]

    def run(self, queries: DataFrame, data: DataFrame, fn, schema: str) -> DataFrame:
        """fn(query frame, data frame, function that walks over (place in the data, boolean matrix of pairs within eps) by tiles) -> frame."""
        eps, p, block = self.eps, self.p, self.block

        def near(left, x, right, y):
            out = []
            for t in tiles(len(x), block):
                walk = lambda t=t: ((u, within(x[t], y[u], eps, p)) for u in tiles(len(y), block))
                out.append(fn(left.iloc[t], right, walk))
            return pd.concat(out, ignore_index=True)

        return run_blocks(queries.drop("dp"), data.withColumnRenamed("qid", "id"), near, schema, self.centres.shape[-1], self.reach, block)


def count_within(left: pd.DataFrame, right: pd.DataFrame, walk) -> pd.DataFrame:
    """(qid, n): copies (m) of data rows within eps."""
    m = right["m"].to_numpy()
    return pd.DataFrame({"qid": left["qid"].to_numpy(), "n": sum(near @ m[u] for u, near in walk())})


def neighbour_counts(df: DataFrame, id_col: str, features: str, eps: float, p: int = 2, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """(id, n): number of rows within eps, the row itself included."""
    rows = cut(vectors(df, id_col, features))
    distinct = cut(rows.groupBy("v").agg(F.min("id").alias("qid"), F.count("*").alias("m")))
    rb = RadiusBlocks(distinct, eps, p, pivots, block)

    per = rb.run(rb.rows, rb.rows, count_within, f"qid {dict(distinct.dtypes)['qid']}, n long").groupBy("qid").agg(F.sum("n").alias("n"))
    table = distinct.join(per, "qid").select("v", F.col("m"), "n")
    return lookup(rows, cut(table), "v", "m", BROADCAST_VECTORS).select(F.col("id").alias(id_col), "n")


# ---------------------------------------------------------------- connected components


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) with component = smallest node, by alternating large-star and small-star steps.

    After Kiveris et al., "Connected components in MapReduce and beyond" (2014). Minima are aggregates
    with map-side combine and the join back goes through :func:`lookup`, so hub nodes do not skew. Every
    round is written to the shared folder, which keeps the plan short.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "a"))
        joined = lookup(both, low, "a", "n")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    for _ in range(rounds):
        new = cut(star(cut(star(e, True)), False))
        if new.count() == e.count() and new.exceptAll(e).isEmpty():
            break
        e = new
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )


def _pair_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances by one matrix product; pairs so near that digits cancel are taken by their differences."""
    xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    size = xx[:, None] + yy
    d = size - 2.0 * (x @ y.T)
    i, j = np.nonzero(~(d > 1e-5 * size))
    d = np.sqrt(np.maximum(d, 0.0))
    for at in range(0, len(i), 65_536):
        a, b = i[at : at + 65_536], j[at : at + 65_536]
        gap = x[a] - y[b]
        d[a, b] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return d


def silhouette_blocks(df: DataFrame, id_col: str, features: str, label: str, limit: int | None = None) -> DataFrame:
    """(id, label, s): Euclidean silhouette per row, from per-cluster distance sums of blocks.

    The measure itself compares every row with every other, in blocks of bounded size, so its time grows with the square
    of the rows; ``limit`` refuses more rows than that. :func:`lakelens.operators.cluster.silhouette` has the linear form.
    """
    rows = cut(vectors(df, id_col, features).join(df.select(col(id_col).alias("id"), col(label).cast("string").alias("g")), "id"))
    if limit is not None and rows.count() > limit:
        raise ValueError(f"pairwise silhouette is limited to {limit} rows; use the squared form")
    sizes = {g: n for g, n in rows.groupBy("g").agg(F.count("*")).collect()}

    def sums(left, x, right, y):
        names, code = np.unique(right["g"].dropna().to_numpy(dtype=str), return_inverse=True)
        order = np.flatnonzero(right["g"].notna())[np.argsort(code, kind="stable")]
        y, code, total = y[order], np.sort(code), np.zeros((len(x), len(names)))
        for t in tiles(len(x), BLOCK):
            for u in tiles(len(y), BLOCK):
                groups, starts = np.unique(code[u], return_index=True)
                total[t, groups] += np.add.reduceat(_pair_distances(x[t], y[u]), starts, axis=1)
        qid, own = (np.repeat(left[c].to_numpy(), len(names)) for c in ("qid", "g"))
        return pd.DataFrame({"qid": qid, "own": own, "g": np.tile(names, len(x)), "s": total.ravel()})

    idt = dict(rows.dtypes)["id"]
    dims = rows.select(F.max(F.size("v"))).first()[0] or 1
    total = run_blocks(rows.select(F.col("id").alias("qid"), "v", "g", F.lit(0).alias("cell")), rows, sums, f"qid {idt}, own string, g string, s double", dims, block=BLOCK)
    size = F.create_map(*[x for g, n in sizes.items() for x in (F.lit(g), F.lit(float(n)))])
    per = total.groupBy("qid", "own", "g").agg(F.sum("s").alias("s"))
    agg = per.groupBy("qid", "own").agg(
        F.max(F.when(F.col("g") == F.col("own"), F.col("s") / (size[F.col("g")] - 1))).alias("a"),
        F.min(F.when(F.col("g") != F.col("own"), F.col("s") / size[F.col("g")])).alias("b"),
    )
    s = F.when(size[F.col("own")] == 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return agg.select(F.col("qid").alias(id_col), F.col("own").alias(label), s.alias("s"))
