"""Toxicity: a counterfactually regularised classifier.

Features of a text are the words it has and the beginnings of its words, present or absent; those that go with the
labels are kept, by counts that Spark makes over the sample of labelled rows (at most MAX_SAMPLE, equal texts once). A
logistic regression over them is trained on this sample. Its loss has a second term: every training text is also read with its identity
terms swapped for others of their group, and the squared change of its logit, times a weight, is added. A score then
can't lean on which group a text names, which is what makes neutral mentions false alarms.

Any text gets a score: an empty or null one has no features and scores as the intercept. Scores depend on the text alone.
Rows without a label, or with a null one, are only scored; a document with several labels counts by the largest. Without labels of both kinds
every score is (nearly) the one label there is, 0 without any. Extra columns are left out; equal rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuemill.llm.wordcodes import chunks
from queuemill.runtime import materialise

#: Groups of identity terms; a term is swapped for the next of its group.
IDENTITY_GROUPS = (
    ("men", "women"), ("man", "woman"), ("male", "female"), ("boy", "girl"), ("boys", "girls"), ("he", "she"), ("his", "her"),
    ("straight", "gay", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("christian", "muslim", "jewish", "buddhist", "hindu", "atheist"), ("christians", "muslims", "jews", "buddhists", "hindus", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "mexican", "arab", "chinese", "indian"),
    ("young", "old"), ("blind", "deaf", "disabled"), ("immigrants", "refugees", "natives"),
    ("mann", "frau"), ("männer", "frauen"), ("junge", "mädchen"), ("christ", "muslim", "jude"), ("christen", "muslime", "juden"),
    ("homme", "femme"), ("hommes", "femmes"), ("garçon", "fille"), ("chrétiens", "musulmans", "juifs"),
    ("hombre", "mujer"), ("hombres", "mujeres"), ("niño", "niña"), ("cristianos", "musulmanes", "judíos"),
)
SWAPS = {term: group[(k + 1) % len(group)] for group in IDENTITY_GROUPS for k, term in enumerate(group)}

PREFIXES = (4, 5, 6)
#: At most so many features, so many rows in the regression, and so many words in a worker's cache.
MAX_FEATURES, MAX_SAMPLE, CACHE = 6_000, 30_000, 300_000
#: A feature must be in so many rows and so many standard deviations more often in rows of label 1 than by chance.
MIN_ROWS, MIN_DEVIATIONS = 5, 6.0
COUNTERFACTUAL, RIDGE, ROUNDS = 1.0, 1e-3, 250
#: Bytes of text whose features are counted at a time.
COUNTED = 500_000
WORDS = regex.compile(r"[\p{L}\p{N}]+")


def learnable(doc_id: Column) -> Column:
    """Labels are learned from rows whose remainder isn't 2; the others are held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 != 2, F.lit(True))


def features_of(word: str) -> tuple[str, ...]:
    return (word, *[f"{word[:k]}*" for k in PREFIXES if len(word) > k])


def words_in(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


class Model(NamedTuple):
    weights: dict[str, float]
    intercept: float


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[list[int]], swapped: list[list[int]], labels: np.ndarray, features: int) -> np.ndarray:
    """Weights and, last, the intercept, by Adam on the mean log loss plus the two penalties."""
    def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return (np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([f for x in lists for f in x], np.int64))

    (r, f), (rs, fs) = flat(rows), flat(swapped)
    n, w = len(rows), np.zeros(features + 1)
    w[-1] = np.log((labels.mean() + 1e-6) / (1 - labels.mean() + 1e-6))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, ROUNDS + 1):
        z = np.bincount(r, w[f], n) + w[-1]
        change = z - np.bincount(rs, w[fs], n) - w[-1]
        error = (_sigmoid(z) - labels) / n
        pull = 2 * COUNTERFACTUAL * change / n
        grad = np.zeros_like(w)
        grad[:-1] = np.bincount(f, (error + pull)[r], features) - np.bincount(fs, pull[rs], features) + 2 * RIDGE * w[:-1] / n ** 0.5
        grad[-1] = error.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        w -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    return w


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) to the number of rows with each feature, by label, per piece of a batch."""
    for batch in batches:
        for part in chunks(batch, 0, COUNTED):
            counts: dict[str, list[int]] = {}
            for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for feature in {f for w in words_in(text) for f in features_of(w)}:
                    counts.setdefault(feature, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[0] for c in counts.values()], pa.int64()),
                                              pa.array([c[1] for c in counts.values()], pa.int64())], names=["feature", "in0", "in1"])


def _training_rows(batches: Iterator[pa.RecordBatch], known: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """(text, label) to the known features of the text and of its counterfactual."""
    def codes(words: set[str]) -> list[int]:
        return sorted({known[f] for w in words for f in features_of(w) if f in known})

    for batch in batches:
        words = [words_in(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            pa.array([codes(w) for w in words], pa.list_(pa.int32())),
            pa.array([codes({SWAPS.get(x, x) for x in w}) for w in words], pa.list_(pa.int32())), batch.column(1)],
            names=["own", "swapped", "label"])


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label) of at most MAX_SAMPLE labelled documents that may be learned from, equal texts once.

    The labels are sampled first, by digest of the id and so the same in every run; being bounded, they are sent to the
    documents, which stay where they are.
    """
    marked = (labels.where("toxic IS NOT NULL").where(learnable(F.col("doc_id"))).groupBy("doc_id")
              .agg(F.max("toxic").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_SAMPLE))
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marked), "doc_id")
            .groupBy("text").agg(F.max("label").alias("label")))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = materialise(labelled_sample(docs, labels), "labelled-sample")
    size = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}      # two rows
    if not size.get(0) or not size.get(1):
        return Model({}, 40.0 if size.get(1) else -40.0)
    base = size[1] / (size[0] + size[1])
    identity = sorted({f for group in IDENTITY_GROUPS for term in group for f in features_of(term)})
    among = F.col("in0") + F.col("in1")
    # How many standard deviations the rows of label 1 are above chance.
    above = (F.col("in1") - among * base) / F.sqrt(among * base * (1 - base))
    chosen = (rows.mapInArrow(_count_words, "feature string, in0 long, in1 long")
              .groupBy("feature").agg(F.sum("in0").alias("in0"), F.sum("in1").alias("in1"))
              .where((among >= MIN_ROWS) & ((above >= MIN_DEVIATIONS) | F.col("feature").isin(identity)))
              .orderBy(F.desc(above), "feature").limit(MAX_FEATURES))
    known = {r["feature"]: k for k, r in enumerate(chosen.select("feature").collect())}      # at most MAX_FEATURES
    got = rows.mapInArrow(lambda b: _training_rows(b, known), "own array<int>, swapped array<int>, label int").toPandas()
    w = fit([list(x) for x in got["own"]], [list(x) for x in got["swapped"]], got["label"].to_numpy(float), len(known))
    return Model({f: float(w[k]) for f, k in known.items()}, float(w[-1]))


def scores_of(texts: list[str | None], model: Model, cache: dict[str, tuple[str, ...]]) -> list[float]:
    """`cache` has the model's features of words met before."""
    weights, scores = model.weights, []
    for text in texts:
        found: set[str] = set()
        for word in words_in(text or ""):
            own = cache.get(word)
            if own is None:
                if len(cache) >= CACHE:
                    cache.clear()
                own = cache[word] = tuple(f for f in features_of(word) if f in weights)
            if own:
                found.update(own)
        # Summed in a fixed order, so that equal texts have equal scores.
        scores.append(float(_sigmoid(np.array(sum((weights[f] for f in sorted(found)), model.intercept)))))
    return scores


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, score)."""
    cache: dict[str, tuple[str, ...]] = {}
    for batch in batches:
        for part in chunks(batch, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores_of(part.column(1).to_pylist(), model, cache), pa.float64())],
                                             names=["doc_id", "score"])


def _keep(batches: Iterator[pa.RecordBatch], model: Model, text: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """The rows, with all their columns, that score below the threshold."""
    cache: dict[str, tuple[str, ...]] = {}
    for batch in batches:
        for part in chunks(batch, text):
            yield part.filter(pa.array([s < threshold for s in scores_of(part.column(text).to_pylist(), model, cache)], pa.bool_()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        lambda batches: _score(batches, shared.value), "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return score(docs, train(docs, labels)).select(
        "doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    text = docs.columns.index("text")
    return docs.mapInArrow(lambda batches: _keep(batches, shared.value, text, threshold), docs.schema)
