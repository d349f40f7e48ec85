"""Classifiers and regressors by name, each with its search space.

Spark ML learners are used where they exist. Linear discriminant and Bayesian ridge are fitted from one
p x p aggregate; the RBF kernel is approximated by random Fourier features in front of a linear learner.
All estimators read ``features`` / ``label`` and write ``prediction``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import functions as F

from lakelens.functions.columns import col
from lakelens.plans.matrix import array_udf, as_array, gram

SEED = 123


class _Io(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    pass


class _LinearModel(Model, _Io, DefaultParamsReadable, DefaultParamsWritable):
    """Scores = intercept + coefficients . x per output; prediction = the score or the best class."""

    fitted = Param(Params._dummy(), "fitted", "coefficients, intercepts and classes", typeConverter=TypeConverters.identity)

    def _transform(self, df):
        f = self.getOrDefault(self.fitted)
        w, b, classes = np.array(f["coefficients"]), np.array(f["intercepts"]), f.get("classes")

        def predict(x):
            s = x @ w.T + b
            return s[:, 0] if classes is None else np.array(classes, float)[s.argmax(axis=1)]

        x = as_array(df, self.getFeaturesCol())
        out = df.withColumn(self.getPredictionCol(), array_udf(predict, "double")(x))
        if classes is not None:
            out = out.withColumn("probability", array_to_vector(array_udf(lambda v: _softmax(v @ w.T + b), "array<double>")(x)))
        return out


def _softmax(s):
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class LinearDiscriminant(Estimator, _Io, DefaultParamsReadable, DefaultParamsWritable):
    """Class means and the pooled covariance from one grouped aggregate, then a p x p solve."""

    def _fit(self, df):
        y = self.getLabelCol()
        parts = gram(df.withColumn("__g", col(y).cast("double").cast("string")), self.getFeaturesCol(), by="__g")
        classes = sorted(parts, key=float)
        n = sum(parts[c][0, 0] for c in classes)
        means = np.array([parts[c][0, 1:] / parts[c][0, 0] for c in classes])
        within = sum(parts[c][1:, 1:] - parts[c][0, 0] * np.outer(m, m) for c, m in zip(classes, means)) / n
        w = means @ np.linalg.pinv(within)
        b = np.array([math.log(parts[c][0, 0] / n) for c in classes]) - 0.5 * np.einsum("ij,ij->i", w, means)
        return self._copyValues(_LinearModel())._set(fitted={"coefficients": w.tolist(), "intercepts": b.tolist(), "classes": [float(c) for c in classes]})


class BayesianRidge(Estimator, _Io, DefaultParamsReadable, DefaultParamsWritable):
    """Evidence iterations on one Gram matrix (MacKay updates with Gamma priors)."""

    alpha_1 = Param(Params._dummy(), "alpha_1", "shape of the noise prior", typeConverter=TypeConverters.toFloat)
    alpha_2 = Param(Params._dummy(), "alpha_2", "rate of the noise prior", typeConverter=TypeConverters.toFloat)
    lambda_1 = Param(Params._dummy(), "lambda_1", "shape of the weight prior", typeConverter=TypeConverters.toFloat)
    lambda_2 = Param(Params._dummy(), "lambda_2", "rate of the weight prior", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, alpha_1=1e-6, alpha_2=1e-6, lambda_1=1e-6, lambda_2=1e-6):
        super().__init__()
        self._setDefault(alpha_1=1e-6, alpha_2=1e-6, lambda_1=1e-6, lambda_2=1e-6)
        self._set(**self._input_kwargs)

    def _fit(self, df):
        a1, a2, l1, l2 = (self.getOrDefault(p) for p in ("alpha_1", "alpha_2", "lambda_1", "lambda_2"))
        g = gram(df, self.getFeaturesCol(), extra=[self.getLabelCol()])[""]
        n, mean = g[0, 0], g[0, 1:] / g[0, 0]
        c = g[1:, 1:] - n * np.outer(mean, mean)
        xx, xy, yy = c[:-1, :-1], c[:-1, -1], c[-1, -1]
        vals, vecs = np.linalg.eigh(xx)
        vals = np.maximum(vals, 0)
        alpha, lam, rhs, w = 1.0 / (yy / n + 1e-300), 1.0, vecs.T @ xy, None
        for _ in range(300):
            new = vecs @ (rhs / (vals + lam / alpha))
            sse = max(yy - 2 * new @ xy + new @ xx @ new, 0.0)
            gamma = float(np.sum(alpha * vals / (lam + alpha * vals)))
            lam = (gamma + 2 * l1) / (new @ new + 2 * l2)
            alpha = (n - gamma + 2 * a1) / (sse + 2 * a2)
            if w is not None and np.abs(w - new).sum() < 1e-3:
                break
            w = new
        w = vecs @ (rhs / (vals + lam / alpha))
        return self._copyValues(_LinearModel())._set(fitted={"coefficients": [w.tolist()], "intercepts": [float(mean[-1] - mean[:-1] @ w)], "classes": None})


def _waves(width: int, size: int, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """Random frequencies and phases of the Fourier features."""
    rng = np.random.default_rng(SEED)
    w = rng.standard_normal((width, size)) * math.sqrt(2 * gamma)
    return w, rng.uniform(0, 2 * math.pi, size)


class FourierFeatures(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """sqrt(2/D) cos(Wx + b): inner products approximate exp(-gamma |x - y|^2)."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", typeConverter=TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of random features", typeConverter=TypeConverters.toInt)
    outputCol = Param(Params._dummy(), "outputCol", "output", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, gamma=0.1, size=200, outputCol="fourier"):
        super().__init__()
        self._set(**{"gamma": gamma, "size": size, "outputCol": outputCol})

    def _transform(self, df):
        g, d = self.getOrDefault(self.gamma), self.getOrDefault(self.size)

        def lift(x):
            w, b = _waves(x.shape[1], d, g)
            return math.sqrt(2.0 / d) * np.cos(x @ w + b)

        return df.withColumn(self.getOrDefault(self.outputCol), array_to_vector(array_udf(lift, "array<double>")(as_array(df, self.getFeaturesCol()))))


def _hinge(f, y, theta, band):
    """(loss, slope, curvature) of the hinge at margin f for y = -1 or 1; the corner is a parabola over 1 - band .. 1 + band."""
    d = 1 - y * f
    s = np.clip((d + band) / (2 * band), 0, 1)
    return np.where(d >= band, d, band * s * s).sum(), -y * s, np.where((d > -band) & (d < band), 1 / (2 * band), 0.0), None


def _huber(f, y, theta, epsilon):
    """The same of Huber's loss with the scale theta[-1], and its derivatives by the scale: slope, curvature, mixed terms."""
    scale, r = theta[-1], y - f
    inner = np.abs(r) <= epsilon * scale
    q = np.where(inner, r / scale, 0.0)
    loss = 0.5 * np.where(inner, scale + r * q, scale + 2 * epsilon * np.abs(r) - scale * epsilon**2).sum()
    slope = -np.where(inner, q, epsilon * np.sign(r))
    return loss, slope, inner / scale, (0.5 * np.where(inner, 1 - q * q, 1 - epsilon**2).sum(), (q * q).sum() / scale, q / scale)


class RbfMachineModel(Model, _Io, DefaultParamsReadable, DefaultParamsWritable):
    """Weights of Fourier features, which are made of ``features`` batch by batch; margins go to ``rawPrediction``."""

    fitted = Param(Params._dummy(), "fitted", "weights by output, the last for the constant; gamma, size and task", typeConverter=TypeConverters.identity)

    def _transform(self, df):
        f = self.getOrDefault(self.fitted)
        weights, size, gamma, task = np.array(f["weights"]), f["size"], f["gamma"], f["task"]

        def margins(x):
            w, b = _waves(x.shape[1], size, gamma)
            return np.cos(x @ w + b) @ weights[:, :-1].T + weights[:, -1]

        x = as_array(df, self.getFeaturesCol())
        if task == "regression":
            return df.withColumn(self.getPredictionCol(), array_udf(lambda v: margins(v)[:, 0], "double")(x))
        m = F.col("__margins")
        raw = F.array(-m[0], m[0]) if task == "binary" else m
        best = (m[0] > 0).cast("double") if task == "binary" else (F.array_position(m, F.array_max(m)) - 1).cast("double")
        out = df.withColumn("__margins", array_udf(margins, "array<double>")(x))
        return out.withColumns({"rawPrediction": array_to_vector(raw), self.getPredictionCol(): best}).drop("__margins")


class RbfMachine(Estimator, _Io, DefaultParamsReadable, DefaultParamsWritable):
    """Support vectors with an RBF kernel: a linear learner on random Fourier features that are not stored.

    Minimises mean loss + regParam / 2 |w|^2 over standardised Fourier features, with a free constant: the hinge (``binary``,
    or one class against all others) or Huber's loss with its scale (``regression``), as Spark's LinearSVC and
    LinearRegression do. Those keep all Fourier features of all rows; here rows are packed as they are, each step of Newton's
    method is one pass that makes the features of some thousand rows at a time, and only sums of loss, slopes and curvature
    (size x size) leave a task. The corner of the hinge is a parabola that narrows step by step to BANDS[-1].
    """

    BLOCK = 4096  # rows that are lifted at a time
    BANDS = (2.0, 0.6, 0.2)  # the first holds the margins 0 of the start
    STEPS = 25  # of Newton's method, for each band
    FEW = 16  # tasks whose sums go to the driver as they are

    task = Param(Params._dummy(), "task", "binary, classes or regression", typeConverter=TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "kernel width", typeConverter=TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of random features", typeConverter=TypeConverters.toInt)
    regParam = Param(Params._dummy(), "regParam", "weight of the squares", typeConverter=TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "residuals beyond epsilon scales count linearly", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, task="binary", gamma=0.1, size=200, regParam=0.0, epsilon=1.35):
        super().__init__()
        self._set(**{"task": task, "gamma": gamma, "size": size, "regParam": regParam, "epsilon": epsilon, **self._input_kwargs})

    def _fit(self, df):
        task, gamma, size, reg, epsilon = (self.getOrDefault(p) for p in (self.task, self.gamma, self.size, self.regParam, self.epsilon))
        blocks = _blocks(df.select(as_array(df, self.getFeaturesCol()).alias("x"), col(self.getLabelCol()).cast("double").alias("y")), self.BLOCK).persist()
        try:
            few = blocks.select(F.spark_partition_id()).distinct().count() <= self.FEW
            n, top, sums = _lifted_sums(blocks, few, size, gamma, None, None, None, None)
            if not n:
                raise ValueError("no rows to fit")
            mean = sums[: size, size] / n
            std = np.sqrt(np.maximum(np.diag(sums)[:size] - n * mean**2, 0) / max(n - 1, 1))
            use = std > 1e-12
            # theta of standardised features = change @ theta of cosines and the constant
            change = np.zeros((size + 1, size + 1))
            change[np.arange(size), np.arange(size)] = np.where(use, 1 / np.where(use, std, 1), 0)
            change[size] = np.append(-mean * np.diag(change)[:size], 1.0)
            ridge = np.append(np.full(size, reg), 0.0)
            if task == "regression":
                xy, yy = sums[: size + 1, size + 1], sums[size + 1, size + 1]
                h, g = change.T @ sums[: size + 1, : size + 1] @ change / n + np.diag(ridge), change.T @ xy / n
                start = np.linalg.lstsq(h, g, rcond=1e-12)[0]
                scale = math.sqrt(max(yy / n - 2 * start @ g + start @ (h - np.diag(ridge)) @ start, 0.0)) or 1e-9
                wide = np.eye(size + 2)
                wide[: size + 1, : size + 1] = change
                theta = _newton(lambda t: _lifted_sums(blocks, few, size, gamma, wide @ t, _huber, epsilon, None), wide, np.append(start, scale), np.append(ridge, 0.0), n, self.STEPS, 1e-7, positive=True)
                found = [change @ theta[:-1]]
            else:
                found = []
                for c in [1] if task == "binary" else range(int(top) + 1):
                    theta = np.zeros(size + 1)
                    for band in self.BANDS:
                        theta = _newton(lambda t, band=band, c=c: _lifted_sums(blocks, few, size, gamma, change @ t, _hinge, band, c), change, theta, ridge, n, self.STEPS, 1e-4)
                    found.append(change @ theta)
        finally:
            blocks.unpersist()
        return self._copyValues(RbfMachineModel())._set(fitted={"weights": [w.tolist() for w in found], "size": size, "gamma": gamma, "task": task})


def _blocks(rows, most: int):
    """(x, y) with up to ``most`` rows in each, as bytes of doubles."""

    def pack(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                part = batch.slice(i, most)
                x, y = part.column(0).flatten().to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(float).tobytes()], pa.binary()), pa.array([y.astype(float).tobytes()], pa.binary())], names=["x", "y"])

    return rows.mapInArrow(pack, "x binary, y binary")


def _lifted_sums(blocks, few: bool, size: int, gamma: float, theta, loss, width, positive):
    """(loss, slopes, curvature) over all rows at ``theta``; without a ``loss`` (rows, largest label, cross products of cosines, 1 and y).

    ``positive`` is the label that counts as 1 against all others. Each task adds up its blocks; unless there are ``few`` tasks, eight add up these.
    """

    def part(batches):
        total = None
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                y = np.frombuffer(y)
                x = np.frombuffer(x).reshape(len(y), -1)
                w, b = _waves(x.shape[1], size, gamma)
                z = np.empty((len(y), size + 1))
                np.cos(x @ w + b, out=z[:, :size])
                z[:, size] = 1.0
                if loss is None:
                    z = np.column_stack([z, y])
                    got, top = [len(y), *(z.T @ z).ravel()], y.max()
                else:
                    goal = y if positive is None else np.where(y == positive, 1.0, -1.0)
                    value, slope, bend, scale = loss(z @ theta[: size + 1], goal, theta, width)
                    some = bend > 0
                    g, h = z.T @ slope, (z[some] * bend[some, None]).T @ z[some]
                    if scale is not None:
                        mixed = z.T @ scale[2]
                        g, h = np.append(g, scale[0]), np.block([[h, mixed[:, None]], [mixed[None, :], np.array([[scale[1]]])]])
                    got, top = [value, *g, *h.ravel()], 0.0
                got = np.array(got)
                total = (got, top) if total is None else (total[0] + got, max(total[1], top))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total[0].tobytes()], pa.binary()), pa.array([float(total[1])])], names=["sums", "top"])

    def add(batches):
        total, top = None, None
        for batch in batches:
            for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = np.frombuffer(s)
                total, top = (s, t) if total is None else (total + s, max(top, t))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([top])], names=["sums", "top"])

    kind = "sums binary, top double"
    parts = blocks.mapInArrow(part, kind)
    found = (parts if few else parts.repartition(8).mapInArrow(add, kind)).collect()
    if not found:
        return 0, None, None
    sums, top = sum(np.frombuffer(r["sums"]) for r in found), max(r["top"] for r in found)
    k = size + 2 if loss is None or loss is _huber else size + 1
    if loss is None:
        return int(sums[0]), top, sums[1:].reshape(k, k)
    return sums[0], sums[1 : k + 1], sums[k + 1 :].reshape(k, k)


def _newton(sums, change, theta, ridge, n, steps: int, least: float, positive: bool = False):
    """Minimum of sums / n + ridge / 2 theta^2 by Newton's method; a step is halved until the value falls, and steps that promise less than the share ``least`` end it. ``positive``: the last one stays so."""

    def at(t):
        value, g, h = sums(t)
        return value / n + 0.5 * ridge @ (t * t), change.T @ g / n + ridge * t, change.T @ h @ change / n + np.diag(ridge)

    value, g, h = at(theta)
    for _ in range(steps):
        step = -np.linalg.solve(h + np.eye(len(h)) * (1e-10 * np.trace(h) / len(h) + 1e-12), g)
        fall = g @ step
        if fall > -least * max(abs(value), 1e-12):
            break
        rate = 1.0
        if positive and step[-1] < 0:
            rate = min(1.0, 0.9 * theta[-1] / -step[-1])
        for _ in range(12):
            new = at(theta + rate * step)
            if new[0] <= value + 1e-4 * rate * fall:
                break
            rate /= 2
        else:
            break
        theta, (value, g, h) = theta + rate * step, new
    return theta


def margin_probabilities(margin):
    """softmax([-m, m]) as a column expression, for models that give a margin only."""
    e = F.exp(2 * margin)
    return F.array(1 / (1 + e), e / (1 + e))


class MarginProbability(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``probability`` = softmax of ``rawPrediction``, for models that give margins only: [-m, m] of two classes, one margin for each of more."""

    def _transform(self, df):
        raw = vector_to_array("rawPrediction")
        e = F.transform(raw, lambda x: F.exp(x - F.array_max(raw)))
        total = F.aggregate("__margin", F.lit(0.0), lambda a, x: a + x)
        out = df.withColumn("__margin", e).withColumn("probability", array_to_vector(F.transform("__margin", lambda x: x / total)))
        return out.drop("__margin")


def _with_probability(*stages):
    return Pipeline(stages=[*stages, MarginProbability()])


@dataclass
class Spec:
    """A named model: how to build it and the ranges of its parameters (low, high) or list of choices."""

    name: str
    build: object
    space: dict = field(default_factory=dict)
    integer: tuple = ()


def _ovr(learner, binary: bool):
    """The learner itself for two classes; one learner for each of more, whose margins make probabilities."""
    return learner if binary else _with_probability(C.OneVsRest(classifier=learner))


def _linear_svc(strength, n_rows, binary):
    return _with_probability(_svc(strength, n_rows)) if binary else _ovr(_svc(strength, n_rows), binary)


def classifiers(n_rows: int, n_cols: int, binary: bool, n_classes: int) -> dict[str, Spec]:
    """Classification registry. ``n_rows`` turns an inverse strength C into regParam = 1 / (C n)."""

    def logit(**kw):
        return C.LogisticRegression(maxIter=100, **kw)

    c_range, alpha = {"C": (0.001, 1.0)}, {"alpha": (0.001, 1000.0)}
    tree = {"maxDepth": (1, min(30, max(2, n_cols)))}
    forest = {"maxDepth": (1, min(15, max(2, n_cols))), "numTrees": (50, 250), "minInstancesPerNode": (1, 4), "impurity": ["gini", "entropy"]}
    boost = {"stepSize": (1e-5, 0.1), "maxIter": (50, 250), "maxDepth": (1, 10), "subsamplingRate": (0.5, 1.0)}
    specs = [
        Spec("GaussianNaiveBayes", lambda: C.NaiveBayes(modelType="gaussian")),
        Spec("LogisticRegression", lambda: logit(regParam=0.0)),
        Spec("Lasso", lambda C=1.0: logit(regParam=1.0 / (C * n_rows), elasticNetParam=1.0), c_range),
        Spec("Ridge", lambda alpha=1.0: logit(regParam=alpha / n_rows, elasticNetParam=0.0), alpha),
        Spec("ElasticNet", lambda C=1.0, l1_ratio=0.5: logit(regParam=1.0 / (C * n_rows), elasticNetParam=l1_ratio), {**c_range, "l1_ratio": (0.015, 1.0)}),
        Spec("LDA", lambda: LinearDiscriminant()),
        Spec("SVM_L", lambda C=1.0: _linear_svc(C, n_rows, binary), c_range),
        Spec("SVM_R", lambda C=1.0, gamma=0.1: Pipeline(stages=[FourierFeatures(gamma=gamma), RbfMachine(task="binary" if binary else "classes", gamma=gamma, regParam=1.0 / (C * n_rows)), MarginProbability()]), {**c_range, "gamma": (0.001, 1.0)}),
        Spec("KNN", lambda k=5, p=2: KNeighbours(k=k, p=p, task="classification"), {"k": (2, min(200, max(3, n_rows - 1))), "p": [1, 2]}, ("k",)),
        Spec("DecisionTree", lambda **kw: C.DecisionTreeClassifier(seed=SEED, **kw), tree, ("maxDepth",)),
        Spec("RandomForest", lambda **kw: C.RandomForestClassifier(seed=SEED, **{"numTrees": 100, "maxDepth": 8, **kw}), forest, ("maxDepth", "numTrees", "minInstancesPerNode")),
        Spec("BoostedTrees", lambda **kw: _ovr(C.GBTClassifier(seed=SEED, **{"maxIter": 20, **kw}), binary), boost, ("maxIter", "maxDepth")),
        Spec("NeuralNetwork", lambda l1=64, l2=32: C.MultilayerPerceptronClassifier(layers=[n_cols, l1, l2, n_classes], seed=SEED, maxIter=50), {"l1": (1, max(2, n_cols**2)), "l2": (1, max(2, n_cols**2 // 2))}, ("l1", "l2")),
    ]
    return {s.name: s for s in specs}


def _svc(strength, n):
    return C.LinearSVC(regParam=1.0 / (strength * n), maxIter=100)


def regressors(n_rows: int, n_cols: int) -> dict[str, Spec]:
    def linear(**kw):
        return R.LinearRegression(**kw)

    a, l1 = {"alpha": (0.001, 10.0)}, {"l1_ratio": (0.015, 1.0)}
    tree = {"maxDepth": (1, min(30, max(2, n_cols)))}
    forest = {"maxDepth": (1, min(15, max(2, n_cols))), "numTrees": (50, 250)}
    boost = {"stepSize": (1e-5, 0.1), "maxIter": (50, 250), "maxDepth": (1, 12), "subsamplingRate": (0.5, 1.0)}
    prior = {k: (1e-5, 1.0) for k in ("alpha_1", "alpha_2", "lambda_1", "lambda_2")}
    specs = [
        Spec("Linear_Regression", lambda: linear(regParam=0.0, solver="normal")),
        Spec("Lasso", lambda alpha=1.0: linear(regParam=alpha, elasticNetParam=1.0, standardization=False), a),
        Spec("Ridge", lambda alpha=1.0: linear(regParam=alpha / n_rows, elasticNetParam=0.0, solver="normal", standardization=False), {"alpha": (0.001, 1000.0)}),
        Spec("ElasticNet", lambda alpha=1.0, l1_ratio=0.5: linear(regParam=alpha, elasticNetParam=l1_ratio, standardization=False), {**a, **l1}),
        Spec("Bayesian_Ridge", lambda **kw: BayesianRidge(**kw), prior),
        Spec("SVM_L", lambda C=1.0, epsilon=1.35: linear(loss="huber", epsilon=max(1.01, epsilon), regParam=1.0 / (C * n_rows)), {"C": (0.01, 1.0), "epsilon": (1.01, 2.0)}),
        Spec("SVM_R", lambda C=1.0, gamma=0.1: Pipeline(stages=[FourierFeatures(gamma=gamma), RbfMachine(task="regression", gamma=gamma, regParam=1.0 / (C * n_rows))]), {"C": (0.001, 1.0), "gamma": (0.001, 1.0)}),
        Spec("KNN", lambda k=5, p=2: KNeighbours(k=k, p=p, task="regression"), {"k": (2, min(200, max(3, n_rows - 1))), "p": [1, 2]}, ("k",)),
        Spec("DecisionTree", lambda **kw: R.DecisionTreeRegressor(seed=SEED, **kw), tree, ("maxDepth",)),
        Spec("RandomForest", lambda **kw: R.RandomForestRegressor(seed=SEED, **{"numTrees": 100, "maxDepth": 8, **kw}), forest, ("maxDepth", "numTrees")),
        Spec("BoostedTrees", lambda **kw: R.GBTRegressor(seed=SEED, **{"maxIter": 20, **kw}), boost, ("maxIter", "maxDepth")),
    ]
    return {s.name: s for s in specs}


class _NeighboursWriter(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"k": m.k, "p": m.p, "task": m.task})
        m.train.write.mode("overwrite").parquet(f"{path}/train")


class _NeighboursReader(MLReader):
    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        m = KNeighboursModel(self.sparkSession.read.parquet(f"{path}/train"), metadata["k"], metadata["p"], metadata["task"])
        m._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(m, metadata)
        return m


class KNeighboursModel(Model, _Io, MLWritable, MLReadable):
    """Owns the table of training vectors; ``write()`` stores it with the model.

    Each distinct vector is answered once, and its answer goes to its rows by the vector itself (``lookup``), so neither
    a vector that many rows share nor two vectors with one hash do harm.
    """

    def __init__(self, train=None, k=5, p=2, task="classification"):
        super().__init__()
        self.train, self.k, self.p, self.task = train, k, p, task

    def write(self):
        return _NeighboursWriter(self)

    @classmethod
    def read(cls):
        return _NeighboursReader()

    def _transform(self, df):
        from lakelens.operators.knn import knn_predict
        from lakelens.plans.session import BROADCAST_VECTORS, cut, lookup

        rows = df.withColumn("__v", as_array(df, self.getFeaturesCol()))
        distinct = cut(rows.groupBy("__v").agg(F.count("*").alias("__n")).withColumn("__row", F.monotonically_increasing_id()))
        got = knn_predict(self.train, distinct, "__row", "__v", "label", self.k, self.p, self.task, self.getPredictionCol())
        answers = distinct.join(got.withColumn(self.getPredictionCol(), col(self.getPredictionCol()).cast("double")), "__row").drop("__row")
        return lookup(rows, cut(answers), "__v", "__n", BROADCAST_VECTORS).drop("__v")


class KNeighbours(Estimator, _Io):
    """Nearest neighbours as an estimator; equal feature vectors get one answer."""

    def __init__(self, k=5, p=2, task="classification"):
        super().__init__()
        self.k, self.p, self.task = int(k), int(p), task

    def _fit(self, df):
        from lakelens.plans.session import cut

        x = as_array(df, self.getFeaturesCol())
        train = df.select(x.alias("__v"), col(self.getLabelCol()).cast("double").alias("label"))
        train = train.withColumn("__row", F.monotonically_increasing_id())
        return self._copyValues(KNeighboursModel(cut(train), self.k, self.p, self.task))
