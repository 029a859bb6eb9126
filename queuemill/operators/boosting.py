"""Boosted trees, one class against the rest, fitted by a task for each class.

The method is that of Spark's GBTClassifier under OneVsRest: the first tree is fitted to labels of -1 and 1, each later one to what the log
loss leaves, on a drawn share of the rows; a node tries a drawn share of the features and takes the split that lowers the variance most.
Spark ML passes over the rows once for every level of every tree of every class, some ten thousand passes at full settings. Here each
feature is cut at its quantiles over all rows, a row becomes a byte for each feature, and these bytes travel once to each class, whose task
grows all its trees. Rows are sorted there, so that the draws don't depend on how they lie. What is more than HELD bytes goes through Spark ML.
"""

from __future__ import annotations

import base64
import io
import zlib

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuemill import fixed
from queuemill.operators.similarity import list_values
from queuemill.runtime import materialise

HELD = 256 << 20        # bytes of binned features in a task
BINS = 32               # of a feature
ACCURACY = 10_000       # of the quantiles
STEP, ROWS, FEATURES = 0.25, 0.9, 0.7       # size of a step, shares of the rows of a tree and of the features of a node
LEAST_GAIN = 1e-9       # above rounding
SCORED = 1024           # rows scored at a time


def grown(columns: np.ndarray, target: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A regression tree over binned features (a line for each): feature and last bin to the left of each inner node, value of each
    leaf. All trees are full: a node without a split sends every row to the left."""
    n_features = len(columns)
    feature, cut, value = np.zeros(2 ** depth - 1, np.int16), np.full(2 ** depth - 1, BINS, np.uint8), np.zeros(2 ** depth)
    tried = max(1, int(np.ceil(FEATURES * n_features)))
    node = np.zeros(len(target), np.int64)
    means = np.array([target.mean()])
    for level in range(depth):
        width = 2 ** level
        count, total = np.empty((n_features, width, BINS)), np.empty((n_features, width, BINS))
        at = node * BINS
        for f in range(n_features):
            code = at + columns[f]
            count[f] = np.bincount(code, minlength=width * BINS).reshape(width, BINS)
            total[f] = np.bincount(code, target, width * BINS).reshape(width, BINS)
        n_left, s_left = count.cumsum(axis=2), total.cumsum(axis=2)
        n, s = n_left[:, :, -1:], s_left[:, :, -1:]
        n_right, s_right = n - n_left, s - s_left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = s_left ** 2 / n_left + s_right ** 2 / n_right - s ** 2 / n
        gain[(n_left == 0) | (n_right == 0)] = -np.inf
        out = np.argsort(rng.random((width, n_features)), axis=1)[:, tried:]
        gain[out.T, np.arange(width)] = -np.inf
        flat = gain.transpose(1, 0, 2).reshape(width, -1)
        best = flat.argmax(axis=1)
        split = flat[np.arange(width), best] > LEAST_GAIN
        f, b = best // BINS, best % BINS
        own = slice(width - 1, 2 * width - 1)
        feature[own], cut[own] = np.where(split, f, 0), np.where(split, b, BINS)
        sides, every = np.arange(width), np.repeat(means, 2)
        low, high = n_left[f, sides, b], n_right[f, sides, b]
        every[0::2] = np.where(split, s_left[f, sides, b] / np.maximum(low, 1), means)
        every[1::2] = np.where(split, s_right[f, sides, b] / np.maximum(high, 1), means)
        means = every
        node = 2 * node + (columns[feature[own][node], np.arange(len(node))] > cut[own][node])
    value[:] = means
    return feature, cut, value


def leaves(columns: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    node, rows = np.zeros(columns.shape[1], np.int64), np.arange(columns.shape[1])
    inner = len(feature)
    while True:
        node = 2 * node + 1 + (columns[feature[node], rows] > cut[node])
        if not len(node) or node[0] >= inner:
            return node - inner


def boosted(columns: np.ndarray, mine: np.ndarray, rounds: int, depth: int, seed: tuple[int, int]) -> list[np.ndarray]:
    """All trees of a class: their features, cuts and values, a line for each tree."""
    y = np.where(mine, 1.0, -1.0)
    margin, trees = np.zeros(len(y)), []
    for turn in range(rounds):
        rng = np.random.default_rng((*seed, turn))
        target = 4.0 * y / (1.0 + np.exp(2.0 * y * margin)) if turn else y
        drawn = np.flatnonzero(rng.random(len(y)) < ROWS)
        drawn = drawn if len(drawn) else np.arange(len(y))
        feature, cut, value = grown(columns[:, drawn], target[drawn], depth, rng)
        value = value * (STEP if turn else 1.0)
        margin += value[leaves(columns, feature, cut)]
        trees.append((feature, cut, value))
    return [np.stack(x) for x in zip(*trees)]


def _binned(edges: list[np.ndarray]):
    """Rows (y, x) to their labels and bytes, a string of each for a batch."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = list_values(batch.column("x"))[1].reshape(batch.num_rows, len(edges))
                bins = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("y").to_numpy().astype(np.int32).tobytes()], pa.binary()),
                                                  pa.array([bins.tobytes()], pa.binary())], names=["y", "bins"])
    return run


def _class_trees(n_features: int, rounds: int, depth: int, seed: int):
    """The rows that a class's task gets to its trees."""
    def run(batches):
        name, labels, bins = None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column("class")[i].as_py()
                labels.append(np.frombuffer(batch.column("y")[i].as_buffer(), np.int32))
                bins.append(np.frombuffer(batch.column("bins")[i].as_buffer(), np.uint8).reshape(-1, n_features))
        if name is None:
            return
        y, x = np.concatenate(labels), np.concatenate(bins)
        order = _order(y, x)
        feature, cut, value = boosted(np.ascontiguousarray(x[order].T), y[order] == name, rounds, depth, (seed, name))
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in (feature, cut, value)]],
                                         names=["class", "feature", "cut", "value"])
    return run


def _order(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """By bytes and label: rows that are alike in both may stand for each other."""
    whole = np.concatenate([x, y.astype(">i4").view(np.uint8).reshape(len(y), 4)], axis=1)
    return np.argsort(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel(), kind="stable")


class BoostedTrees(Estimator):
    """`features` and the class index `y` to a model of all classes."""

    def __init__(self, rounds: int, depth: int, seed: int = fixed.SEED):
        super().__init__()
        self.rounds, self.depth, self.seed = rounds, depth, seed

    def _fit(self, df: DataFrame) -> Model:
        spark = df.sparkSession
        named = df.schema["y"].metadata.get("ml_attr", {}).get("vals")
        rows = materialise(df.select(F.col("y").cast("int").alias("y"), vector_to_array("features").alias("x")), "boosting-rows")
        wrong = F.exists("x", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("last"), F.max(F.size("x")).alias("dims"), F.count_if(F.coalesce(wrong, F.lit(True))).alias("wrong")).first()
        if facts.wrong or not facts.n:
            raise ValueError("no rows to fit" if not facts.n else "features must not be null, NaN or infinite")
        n_classes = len(named) if named else facts["last"] + 1
        if facts.n * facts.dims > HELD:
            one = GBTClassifier(maxIter=self.rounds, stepSize=STEP, maxDepth=self.depth, subsamplingRate=ROWS, featureSubsetStrategy=str(FEATURES), seed=self.seed)
            return OneVsRest(classifier=one, parallelism=4, featuresCol="features", labelCol="y").fit(df)
        cuts = rows.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(
            F.percentile_approx("v", [k / BINS for k in range(1, BINS)], ACCURACY).alias("at")).collect()       # one row for each feature
        edges = [np.unique(np.array(r["at"], float)) for r in sorted(cuts, key=lambda r: r.f)]
        packed = materialise(rows.mapInArrow(_binned(edges), "y binary, bins binary"), "boosting-bins")
        classes = F.broadcast(spark.range(n_classes).select(F.col("id").cast("int").alias("class")))
        each = packed.crossJoin(classes).repartitionById(n_classes, F.col("class"))
        made = each.mapInArrow(_class_trees(len(edges), self.rounds, self.depth, self.seed), "class int, feature binary, cut binary, value binary").collect()
        feature, cut, value = (np.concatenate([np.frombuffer(r[name], kind).reshape(self.rounds, -1) for r in sorted(made, key=lambda r: r["class"])])
                               for name, kind in (("feature", np.int16), ("cut", np.uint8), ("value", np.float64)))
        limits = np.full((len(edges), BINS + 1), np.inf)
        for f, e in enumerate(edges):
            limits[f, :len(e)] = e
        return BoostedModel.of(*(a.reshape(n_classes, self.rounds, -1) for a in (feature, limits[feature, cut], value)))


class BoostedModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Trees of all classes: margins as `rawPrediction`, and the class of the greatest as `prediction`."""

    fitted = Param(Params._dummy(), "fitted", "features, limits and values of the trees", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, fitted: str = ""):
        super().__init__()
        self._setDefault(fitted="")
        self._set(fitted=fitted)

    @classmethod
    def of(cls, feature: np.ndarray, limit: np.ndarray, value: np.ndarray) -> "BoostedModel":
        kept = io.BytesIO()
        np.savez(kept, feature=feature, limit=limit, value=value)
        return cls(fitted=base64.b64encode(zlib.compress(kept.getvalue())).decode())

    def trees(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kept = np.load(io.BytesIO(zlib.decompress(base64.b64decode(self.getOrDefault(self.fitted)))))
        return kept["feature"].astype(np.int64), kept["limit"], kept["value"]

    def _transform(self, df: DataFrame) -> DataFrame:
        raw = F.arrow_udf(_margins(*self.trees()), "array<double>")(vector_to_array("features"))
        scored = df.withColumn("_margins", raw)
        return scored.withColumns({"rawPrediction": array_to_vector("_margins"), "prediction": (F.array_position("_margins", F.array_max("_margins")) - 1).cast("double")}).drop("_margins")


def _margins(feature: np.ndarray, limit: np.ndarray, value: np.ndarray):
    """Rows to the sums of their leaves, class by class. All classes have as many trees."""
    n_classes, rounds, n_leaves = value.shape
    trees, inner = n_classes * rounds, n_leaves - 1
    feature, limit, value = feature.reshape(-1), limit.reshape(-1), value.reshape(-1)

    def run(rows: pa.Array) -> pa.Array:
        offsets, flat = list_values(rows)
        x = flat.reshape(len(rows), -1) if len(rows) else np.zeros((0, 1))
        out = np.zeros((len(rows), n_classes))
        for low in range(0, len(rows), SCORED):
            some = x[low:low + SCORED]
            line, first = np.arange(len(some))[:, None], np.arange(trees) * inner
            node = np.zeros((len(some), trees), np.int64)
            for _ in range(n_leaves.bit_length() - 1):
                at = node + first
                node = 2 * node + 1 + (some[line, feature[at]] > limit[at])
            found = value[node - inner + np.arange(trees) * n_leaves]
            out[low:low + SCORED] = found.reshape(len(some), n_classes, rounds).sum(axis=2)
        ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * n_classes)
        return pa.ListArray.from_arrays(ends, pa.array(out.ravel()))
    return run
