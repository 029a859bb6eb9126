"""Classifier heads on Spark ML, their tuning by cross-validation, and the jobs built on them.

Rows: id, label (string), features (ML vector), fold. Selection only ever sees training rows.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuemill import fixed
from queuemill.functions import vectors as VX
from queuemill.operators import metrics as M
from queuemill.operators import retrieval as R
from queuemill.operators import sampling as SA
from queuemill.operators import votes as VO
from queuemill.operators.boosting import BoostedTrees
from queuemill.operators.features import literal_array
from queuemill.operators.similarity import list_values
from queuemill.runtime import fresh_path, materialise, rounded

PROBABILITY, MARGIN = "probability", "margin"


# ---------------------------------------------------------------- inputs

def dense_vector(column: str) -> Column:
    return array_to_vector(F.col(column).cast("array<double>"))


def with_sparse_vectors(rows: DataFrame, size: int, tag: str = "sparse-vectors") -> DataFrame:
    """`features` for (idx, val). Spark SQL has no function for sparse vectors, but they are stored as
    a struct: the rows are written with that struct alone and read back as vectors."""
    struct = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).cast("int").alias("size"),
                      F.col("idx").cast("array<int>").alias("indices"), F.col("val").cast("array<double>").alias("values"))
    path, kept = fresh_path(rows.sparkSession, tag), rows.drop("idx", "val")
    rows.select(*kept.columns, struct.alias("features")).write.parquet(path)
    return rows.sparkSession.read.schema(T.StructType([*kept.schema.fields, T.StructField("features", VectorUDT())])).parquet(path)


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (k * n_c) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy()   # one row per class
    return counts.withColumn("weight", F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n")))


def weighted(rows: DataFrame) -> DataFrame:
    return rows.join(balanced_weights(rows, "label").select("label", "weight"), "label")


# ---------------------------------------------------------------- heads by name

def _common(**extra):
    return dict(featuresCol="features", labelCol="y", **extra)


def head_nb(n_rows: int, alpha: float = 1.0):
    return NaiveBayes(modelType="multinomial", smoothing=alpha, **_common())


def head_logreg(n_rows: int, C: float = 1.0, max_iter: int = 100):
    return LogisticRegression(weightCol="weight", regParam=1.0 / (C * n_rows), maxIter=max_iter, standardization=False, **_common())


def head_svm(n_rows: int, C: float = 1.0, max_iter: int = 50):
    one = LinearSVC(regParam=1.0 / (C * n_rows), maxIter=max_iter, standardization=False)
    return OneVsRest(classifier=one, weightCol="weight", parallelism=4, **_common())


def head_rf(n_rows: int, trees: int = 300, min_leaf: int = 1):
    return RandomForestClassifier(weightCol="weight", numTrees=trees, minInstancesPerNode=min_leaf, maxDepth=12,
                                  seed=fixed.SEED, **_common())


def head_gbt(n_rows: int, rounds: int = 150, depth: int = 6):
    return BoostedTrees(rounds, depth)


# Heads by name: builder, settings to try, kind of score.
HEADS = {
    "Multinomial Naive Bayes": (head_nb, [{"alpha": a} for a in (0.05, 0.1, 0.3, 1.0)], PROBABILITY),
    "Logistic Regression": (head_logreg, [{"C": c} for c in (1.0, 3.0, 10.0, 30.0)], PROBABILITY),
    "Linear SVM": (head_svm, [{"C": c} for c in (0.3, 1.0, 3.0)], MARGIN),
    "Random Forest": (head_rf, [{"min_leaf": n} for n in (1, 2)], PROBABILITY),
    "Boosted Trees": (head_gbt, [{}], MARGIN),
}
# Candidates over sentence vectors, besides the neighbours; naive Bayes can't take negative numbers.
SELECTED = ("Logistic Regression", "Linear SVM", "Random Forest", "Boosted Trees")


def pipeline(head: str, n_rows: int, **settings) -> Pipeline:
    """Alphabetical label index, then the head."""
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc")
    return Pipeline(stages=[index, HEADS[head][0](n_rows, **settings)])


PART_BYTES = 16 << 20       # of features in a partition that an optimiser goes through
MANY_PASSES = ("Linear SVM", "Logistic Regression")
DRAWN_PASSES = ("Boosted Trees",)
UNWEIGHTED = ("Multinomial Naive Bayes", "Boosted Trees")


def for_passes(head: str, rows: DataFrame, n_rows: int) -> DataFrame:
    """Rows in no more partitions than their bytes are worth. An optimiser makes hundreds of passes, and in each of them every partition
    sends the driver a result: many small ones cost more than the work in them. Boosting passes once for every level of every tree of every
    class; its draws go by partition, so as many partitions as there are cores are left as they are. Forests keep theirs."""
    one = rows.select("features").where("features is not null").first() if head in MANY_PASSES + DRAWN_PASSES else None
    if one is None:
        return rows
    least = rows.sparkSession.sparkContext.defaultParallelism if head in DRAWN_PASSES else 1
    return rows.coalesce(max(least, math.ceil(12 * len(one.features.values) * n_rows / PART_BYTES)))


def fit(head: str, train: DataFrame, **settings) -> PipelineModel:
    n_rows = train.count()
    # The join on the label would send all rows of a class to one task; a head without weights does without it.
    rows = train.where(F.col("label").isNotNull()) if head in UNWEIGHTED else weighted(train)
    return pipeline(head, n_rows, **settings).fit(for_passes(head, rows, n_rows))


def classes(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds `predicted` and the raw output columns; labels are not needed."""
    scored = model.stages[-1].transform(rows)
    return scored.withColumn("predicted", literal_array(classes(model))[F.col("prediction").cast("int")])


def class_scores(model: PipelineModel, rows: DataFrame, head: str) -> DataFrame:
    """Long scores: id, class, class_index, score, score_kind; margins are softmaxed for ranking."""
    kind = HEADS[head][2]
    scored = predict(model, rows)
    raw = vector_to_array(F.col("probability" if kind == PROBABILITY else "rawPrediction"))
    names = literal_array(classes(model))
    long = scored.select("id", F.posexplode(raw).alias("class_index", "score")).select(
        "id", names[F.col("class_index")].alias("class"), F.col("class_index").cast("long").alias("class_index"), "score")
    if kind == MARGIN:
        return VO.softmax_scores(long, ["id"])
    return long.withColumn("score_kind", F.lit(kind))


# ---------------------------------------------------------------- cross-validation

def macro_f1(scored: DataFrame) -> float:
    """Mean F1 over classes; Spark's own `f1` is weighted by support."""
    pairs = scored.select(F.col("y").alias("actual"), F.col("prediction").alias("predicted"))
    return float(M.clf_metrics(pairs, [], 12).first()["f1_macro"])


def cv_scores(head: str, rows: DataFrame, settings: list[dict], parallelism: int = 4) -> list[float]:
    """Mean macro F1 over the folds, one number per setting; only the folds are fitted."""
    indexed = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(rows).transform(weighted(rows))
    indexed = indexed.select("y", "weight", "features", F.col("fold").cast("int").alias("fold"))
    n_folds = rows.select(F.max("fold")).first()[0] + 1
    n_rows = rows.count()
    n_train = n_rows * (n_folds - 1) // n_folds
    indexed = for_passes(head, indexed, n_rows)

    def one_fold(task: tuple[int, int]) -> float:
        setting, fold = task
        model = HEADS[head][0](n_train, **settings[setting]).fit(indexed.where(F.col("fold") != fold))
        return macro_f1(model.transform(indexed.where(F.col("fold") == fold)))

    tasks = [(s, f) for s in range(len(settings)) for f in range(n_folds)]
    with ThreadPoolExecutor(parallelism) as pool:
        scores = list(pool.map(one_fold, tasks))
    return [sum(scores[s * n_folds:(s + 1) * n_folds]) / n_folds for s in range(len(settings))]


def cv_score(head: str, rows: DataFrame, **settings) -> float:
    return cv_scores(head, rows, [settings])[0]


def grid_tune(head: str, rows: DataFrame, settings: list[dict] | None = None) -> tuple[PipelineModel, float, dict]:
    """Best setting by cross-validation (the first of equals), refitted on all rows."""
    settings = settings or HEADS[head][1]
    scores = cv_scores(head, rows, settings)
    best = max(range(len(settings)), key=lambda i: (scores[i], -i))
    return fit(head, rows, **settings[best]), scores[best], settings[best]


def select_head(rows: DataFrame, candidates: dict[str, list[dict]], done_path: str | None = None) -> DataFrame:
    """Every candidate's best score; candidates scored in an earlier run are read, not fitted again."""
    spark = rows.sparkSession
    path = done_path or fresh_path(spark, "heads")
    schema = "position long, head string, settings string, cv_f1 double"
    offered = spark.createDataFrame([(i, name) for i, name in enumerate(candidates)], "position long, head string")
    try:
        done = spark.read.schema(schema).parquet(path)
        pending = [r.head for r in offered.join(done, "head", "left_anti").orderBy("position").collect()]
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        pending = list(candidates)
    for name in pending:
        settings = candidates[name]
        scores = knn_cv_scores(rows, [one["n_neighbors"] for one in settings]) if name == KNN else cv_scores(name, rows, settings)
        best = max(range(len(settings)), key=lambda i: (scores[i], -i))
        spark.createDataFrame([(list(candidates).index(name), name, str(settings[best]), scores[best])], schema).write.mode("append").parquet(path)
    every = spark.read.schema(schema).parquet(path)
    first = F.row_number().over(W.orderBy(F.desc("cv_f1"), "position"))   # one row per candidate
    return every.withColumn("selected", first == 1)


def ablate(rows: DataFrame, spec: list[tuple[str, list[str]]], head: str, settings: dict, alphas=fixed.ALPHAS) -> DataFrame:
    """Blocks added one step at a time, each at its best weight; score and change per step."""
    from queuemill.operators.features import assemble
    spark, table = rows.sparkSession, []
    for step, (name, keys) in enumerate(spec):
        trials = [None] if keys == ["text"] else list(alphas)
        scores = []
        for alpha in trials:
            built = rows.withColumn("features", array_to_vector(assemble(keys, alpha or 1.0)))
            scores.append(cv_score(head, built.select("label", "features", "fold"), **settings))
        best = max(range(len(trials)), key=lambda i: (scores[i], -i))
        table.append((step, name, " + ".join(keys), trials[best], scores[best]))
    steps = spark.createDataFrame(table, "step long, feature_set string, blocks string, block_weight double, cv_f1 double")
    steps = M.delta_vs_previous(steps, [], "step", "cv_f1")
    return steps.withColumn("gain_over_first", rounded(F.col("cv_f1") - F.first("cv_f1").over(W.partitionBy().orderBy("step")), 4))


def oof_scores(head: str, rows: DataFrame, **settings) -> DataFrame:
    """Class scores of every training row from models that never saw it."""
    folds = sorted(r.fold for r in rows.select("fold").distinct().collect())
    parts = []
    for f in folds:
        model = fit(head, rows.where(F.col("fold") != f), **settings)
        parts.append(class_scores(model, rows.where(F.col("fold") == f), head).withColumn("fold", F.lit(f).cast("long")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def svm_calibrated(train: DataFrame, test: DataFrame, C: float = 1.0, folds: int = 3) -> DataFrame:
    """Sigmoid-calibrated SVM: per class, a logistic fit on margins of held-out folds; the class
    probabilities are averaged over the folds' models and scaled to sum 1."""
    placed = materialise(SA.stratified_folds(train.drop("fold"), "label", "id", folds=folds), "folds")

    def one_fold(f: int) -> DataFrame:
        model = fit("Linear SVM", placed.where(F.col("fold") != f), C=C)
        names = literal_array(classes(model))
        margins = lambda df, extra: predict(model, df).select(
            *extra, F.posexplode(vector_to_array("rawPrediction")).alias("class_index", "margin")).withColumn("class", names[F.col("class_index")])
        held = margins(placed.where(F.col("fold") == f), ["id", "label"])
        held = materialise(held.select("class", "margin", (F.col("label") == F.col("class")).cast("double").alias("y")), "margins")

        def sigmoid(name: str) -> tuple[float, float]:
            one = held.where(F.col("class") == name).select(array_to_vector(F.array("margin")).alias("features"), "y")
            fitted = LogisticRegression(labelCol="y", maxIter=50).fit(for_passes("Logistic Regression", one, one.count()))
            return float(fitted.coefficients[0]), float(fitted.intercept)

        with ThreadPoolExecutor(4) as pool:
            fitted = dict(zip(classes(model), pool.map(sigmoid, classes(model))))
        slope = F.create_map(*[F.lit(x) for n, (a, _) in fitted.items() for x in (n, a)])[F.col("class")]
        shift = F.create_map(*[F.lit(x) for n, (_, b) in fitted.items() for x in (n, b)])[F.col("class")]
        p = 1.0 / (1.0 + F.exp(-(slope * F.col("margin") + shift)))
        return margins(test, ["id"]).select("id", "class", F.col("class_index").cast("long").alias("class_index"), p.alias("score"))

    # Folds and classes are small fits of their own: side by side.
    with ThreadPoolExecutor(folds) as pool:
        outputs = list(pool.map(one_fold, range(folds)))
    stacked = reduce(lambda a, b: a.unionByName(b), outputs)
    mean = stacked.groupBy("id", "class", "class_index").agg(F.avg("score").alias("score"))
    return VO.normalised(mean, ["id"]).withColumn("score_kind", F.lit(PROBABILITY))


def score_batch(model: PipelineModel, rows: DataFrame, head: str, abstain_below: float = fixed.ABSTAIN_BELOW) -> DataFrame:
    """A table of tickets scored by one model: label, runner-up, ranking and the decline mark."""
    scores = class_scores(model, rows, head)
    best = VO.argmax_class(scores, ["id"])
    return best.withColumns({"abstain": F.col("confidence") < abstain_below, "score_kind": F.lit(HEADS[head][2])})


def cascade(train: DataFrame, test: DataFrame, upstream: str = "Logistic Regression", downstream: str = "Logistic Regression",
            alpha: float = 0.1) -> DataFrame:
    """Category model → its scores as a block → routing model.

    The routing model is trained on out-of-fold category scores, so it meets at inference what it
    met in training. Rows: id, category, team, features, vec, fold.
    """
    from queuemill.operators.features import ContextBlocks
    labelled = train.withColumnRenamed("category", "label")
    oof = materialise(oof_scores(upstream, labelled.select("id", "label", "features", "fold")), "oof")
    model = fit(upstream, labelled.select("label", "features"))
    held = materialise(class_scores(model, test, upstream), "upstream")
    block = lambda df, scores: df.join(VO.score_block(scores, "id"), "id")
    train_block, test_block = block(train, oof), block(test, held)
    fitter = ContextBlocks([], {}).fit_extra("cat", train_block)
    joined = lambda df: fitter.apply_extra("cat", df).withColumn(
        "features", array_to_vector(F.concat("vec", VX.scaled(F.col("cat"), F.lit(alpha)))))
    router = fit(downstream, joined(train_block).select(F.col("team").alias("label"), "features"))
    routed = score_batch(router, joined(test_block).select("id", "features"), downstream)
    category = VO.argmax_class(held, ["id"]).select("id", F.col("predicted").alias("category"), F.col("confidence").alias("category_confidence"))
    return routed.join(category, "id")


def learning_runs(train: DataFrame, test: DataFrame, head: str, fractions=fixed.FRACTIONS, repeats: int = fixed.REPEATS, **settings) -> DataFrame:
    """Held-out macro F1 of models fitted on stratified samples of growing size."""
    parts = []
    for fraction in fractions:
        for repeat in range(repeats if fraction < 1.0 else 1):
            sample = materialise(SA.stratified_sample(train, "label", "id", fraction, repeat), "sample")
            scored = predict(fit(head, sample, **settings), test)
            parts.append(scored.select(F.lit(float(fraction)).alias("fraction"), F.lit(repeat).alias("repeat"),
                                       F.lit(sample.count()).alias("n_sampled"), F.col("label").alias("actual"), "predicted"))
    stacked = reduce(lambda a, b: a.unionByName(b), parts)
    return M.clf_metrics(stacked, ["fraction", "repeat", "n_sampled"], 12).select("fraction", "repeat", "n_sampled", F.col("f1_macro").alias("f1"))


# ---------------------------------------------------------------- neighbours

KNN = "k-NN (cosine)"


def _fold_neighbours(train: DataFrame, labels: list[str], k: int, key: str, vector: str) -> DataFrame:
    """The k nearest rows outside a row's own fold, with labels of both, in one search.

    A place for each fold is added to the vectors: 1 for the fold of a candidate, and for that of a query a number which puts
    candidates of its own fold below any score and leaves the scores of the others as they are.
    """
    facts = [F.col(key).alias("candidate_id"), *[F.col(c) for c in labels]]
    own = [F.col(key).alias("query_id"), "fold", *[F.col(c).alias(f"true_{c}") for c in labels]]
    ends = train.agg(F.max("fold").alias("last"), F.max(VX.norm(VX.doubles(F.col(vector)))).alias("longest")).first()
    last, reach = ends.last or 0, (ends.longest or 0.0) ** 2       # no score is beyond +-reach
    marked = lambda mark: train.withColumn(vector, F.concat(VX.doubles(F.col(vector)), F.transform(
        F.sequence(F.lit(0), F.lit(last).cast("int")), lambda f: F.when(f == F.col("fold"), F.lit(float(mark))).otherwise(0.0))))
    near = R.semantic_topk(marked(-2 * reach - 1), marked(1), k, key, vector).where(F.col("score") > -reach - 0.5)
    return materialise(near.join(train.select(*facts), "candidate_id").join(train.select(*own), "query_id"), "fold-neighbours")


def _every_k(near: DataFrame, grid) -> DataFrame:
    """Smaller neighbourhoods are read from the ranks of the largest."""
    return near.withColumn("k", F.explode(F.array(*[F.lit(k) for k in grid]))).where(F.col("rank") <= F.col("k"))


def tune_k(train: DataFrame, labels: list[str], grid=fixed.KNN_GRID, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One k for all labels: mean macro F1 over folds and labels; the first best is marked."""
    tagged = _every_k(_fold_neighbours(train, labels, max(grid), key, vector), grid)
    voted = [VO.knn_vote(tagged, c, ("k", "fold", "query_id", f"true_{c}")).select(
        "k", "fold", F.lit(c).alias("what"), F.col(f"true_{c}").alias("actual"), "predicted") for c in labels]
    stacked = reduce(lambda a, b: a.unionByName(b), voted)
    scores = M.clf_metrics(stacked, ["k", "fold", "what"], 12).groupBy("k").agg(rounded(F.avg("f1_macro")).alias("score"))
    first = F.row_number().over(W.orderBy(F.desc("score"), "k"))   # one row per k
    return scores.withColumn("selected", first == 1)


def knn_cv_scores(rows: DataFrame, grid: list[int], key: str = "id", vector: str = "vec") -> list[float]:
    """Mean macro F1 over the folds per k, votes weighted by inverse distance."""
    unit = rows.select(key, "label", "fold", VX.unit(VX.doubles(F.col(vector))).alias(vector))
    tagged = _every_k(_fold_neighbours(unit, ["label"], max(grid), key, vector), grid)
    scores = VO.knn_scores(tagged, "label", ("k", "fold", "query_id", "true_label"))
    order = F.struct((-F.round("score", VO.TIE_DIGITS)).alias("s"), "class")
    best = scores.groupBy("k", "fold", "query_id", F.col("true_label").alias("actual")).agg(F.min(order)["class"].alias("predicted"))
    means = M.clf_metrics(best, ["k", "fold"], 12).groupBy("k").agg(F.avg("f1_macro").alias("f1")).collect()
    by_k = {r.k: float(r.f1) for r in means}
    return [by_k[k] for k in grid]


# ---------------------------------------------------------------- latent semantic vectors

SLICE = 16       # rows multiplied at a time inside a task: more of them share few terms and are mostly zeros
SPLITS = 4       # parts of the table that one task goes through in a pass, at most
POWER_PASSES = 4


TERM_BLOCK = 1024       # terms whose sums travel together


def _slices(batch: pa.RecordBatch):
    """SLICE rows at a time: where they begin, their terms and their weights as a matrix over these terms."""
    offsets, index = list_values(batch.column("idx"))
    values = list_values(batch.column("val"))[1]
    for low in range(0, batch.num_rows, SLICE):
        high = min(low + SLICE, batch.num_rows)
        part = slice(offsets[low], offsets[high])
        terms, place = np.unique(index[part], return_inverse=True)
        x = np.zeros((high - low, len(terms)))
        x[np.repeat(np.arange(high - low), np.diff(offsets[low:high + 1])), place] = values[part]
        yield low, terms, x


def _summed(table: pa.Table) -> pa.Table:
    """Partial sums of one block of terms, each a matrix, to their sum."""
    total = None
    for z in table.column("z"):
        part = np.frombuffer(z.as_py())
        total = part.copy() if total is None else total + part
    return pa.table({"block": table.column("block")[:1], "z": pa.array([total.tobytes()], pa.binary())})


def _for_sums(rows: DataFrame) -> DataFrame:
    """Rows in fewer partitions, as each sends sums as large as the basis: up to SPLITS in one, and a multiple of the cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(cores * max(1, math.ceil(rows.rdd.getNumPartitions() / (SPLITS * cores))))


def _gram_times(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """(X'X) basis in one pass. A task's sums leave it in blocks of terms, those it has rows of; blocks are summed in tasks of their
    own, and the driver gets each once, as many numbers as the basis has."""
    shared = rows.sparkSession.sparkContext.broadcast(basis)

    def run(batches):
        q = shared.value
        total, met = np.zeros_like(q), np.zeros(len(q), bool)
        for batch in batches:
            for _, terms, x in _slices(batch):
                total[terms] += x.T @ (x @ q[terms])
                met[terms] = True
        for number in np.unique(np.flatnonzero(met) // TERM_BLOCK):
            block = total[number * TERM_BLOCK:(number + 1) * TERM_BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["block", "z"])

    partial = rows.select("idx", "val").mapInArrow(run, "block int, z binary")
    out = np.zeros_like(basis)
    for row in partial.groupBy("block").applyInArrow(_summed, "block int, z binary").collect():
        block = np.frombuffer(row.z).reshape(-1, basis.shape[1])
        out[row.block * TERM_BLOCK:row.block * TERM_BLOCK + len(block)] = block
    return out


def _leading(rows: DataFrame, size: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors of the rows, and what the rows' products with each of them square to in sum."""
    rows = _for_sums(rows)
    width = min(size, dims + 10)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    for _ in range(POWER_PASSES):
        basis = np.linalg.qr(_gram_times(rows, basis))[0]
    values, turn = np.linalg.eigh(basis.T @ _gram_times(rows, basis))
    order = np.argsort(-values)[:dims]
    return basis @ turn[:, order], values[order]


def term_basis(rows: DataFrame, size: int, dims: int, seed: int = fixed.SEED) -> np.ndarray:
    """Leading right singular vectors of the rows by subspace iteration: a handful of passes over
    the data whatever the number of dimensions."""
    return _leading(rows, size, dims, seed)[0]


def lsa_vectors(fit_rows: DataFrame, rows: DataFrame, size: int, dims: int = fixed.LSA_DIMS) -> tuple[DataFrame, float]:
    """Sparse TF-IDF rows (key columns, idx, val) to unit vectors of `dims`; explained variance share.

    The term side has at most MAX_TERMS x (dims + 10) numbers, which bounds what is broadcast.
    """
    dims = max(1, min(dims, size - 1))
    basis, squares = _leading(fit_rows, size, dims, fixed.SEED)
    shared = rows.sparkSession.sparkContext.broadcast(basis)
    kept = [f for f in rows.schema.fields if f.name not in ("idx", "val")]

    def project(batches):
        terms_of = shared.value
        for batch in batches:
            out = np.zeros((batch.num_rows, terms_of.shape[1]))
            for low, terms, x in _slices(batch):
                out[low:low + len(x)] = x @ terms_of[terms]
            out /= np.clip(np.linalg.norm(out, axis=1, keepdims=True), 1e-9, None)
            ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.ListArray.from_arrays(ends, pa.array(out.ravel()))],
                                             names=[*[f.name for f in kept], "lsa"])

    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "lsa array<double>"])
    return rows.mapInArrow(project, ddl), explained_variance(basis, squares, fit_rows)


def _term_sums(batches):
    """Sums of the weights, and of their squares, of each term in a task's rows."""
    sums = np.zeros((0, 2))
    for batch in batches:
        index, values = list_values(batch.column("idx"))[1], list_values(batch.column("val"))[1]
        if len(index):
            sums = np.pad(sums, ((0, max(0, int(index.max()) + 1 - len(sums))), (0, 0)))
            sums += np.stack([np.bincount(index, w, len(sums)) for w in (values, values * values)], axis=1)
    met = np.flatnonzero(sums[:, 1])
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), *[pa.array(sums[met, k]) for k in (0, 1)]], names=["idx", "s", "ss"])


def explained_variance(basis: np.ndarray, squares: np.ndarray, fit_rows: DataFrame) -> float:
    """Variance of the projected rows over the variance of the term weights. Both follow from sums per term: a projected mean is the
    mean row's projection, and `squares` are the sums of the squared projections."""
    n = fit_rows.count()
    sums = np.zeros((len(basis), 2))
    per_term = _for_sums(fit_rows.select("idx", "val")).mapInArrow(_term_sums, "idx int, s double, ss double")
    for row in per_term.groupBy("idx").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss")).collect():      # one row for each term
        sums[row.idx] = row.s, row.ss
    means = sums / n
    return float((np.sum(squares) / n - np.sum((means[:, 0] @ basis) ** 2)) / np.sum(means[:, 1] - means[:, 0] ** 2))
