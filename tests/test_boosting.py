"""Boosted trees of a task per class against Spark's own, and the settings of the registered heads."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from queuemill.operators import boosting as B
from queuemill.operators import models as MO

SF = "/root/testdata/sf0.001"


class Asked(Exception):
    pass


def made(n: int, seed: int = 3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, 5))
    return x, x[:, 0] + x[:, 1] * x[:, 2] / 6 + rng.normal(0, 2, n) > 12


def test_trees_are_those_of_spark(spark, monkeypatch):
    # Without draws nothing is left to chance.
    monkeypatch.setattr(B, "ROWS", 2.0)
    monkeypatch.setattr(B, "FEATURES", 1.0)
    x, y = made(200)
    rows = spark.createDataFrame([(int(b), [float(v) for v in a]) for a, b in zip(x, y)], "y int, v array<double>").withColumn("features", array_to_vector("v")).coalesce(1)
    model = GBTClassifier(maxIter=6, stepSize=B.STEP, maxDepth=4, featuresCol="features", labelCol="y").fit(rows)
    want = [r[0][1] for r in model.transform(rows).select(vector_to_array("rawPrediction")).collect()]
    columns = np.ascontiguousarray(x.T.astype(np.uint8))
    feature, cut, value = B.boosted(columns, y, 6, 4, (1, 0))
    assert np.allclose(sum(v[B.leaves(columns, f, c)] for f, c, v in zip(feature, cut, value)), want)


def test_boosting_is_the_same_wherever_rows_lie(spark, tmp_path):
    x, y = made(300)
    data = [(i, "low" if i % 50 == 7 else "yes" if b else "no", [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    rows = spark.createDataFrame(data, "id long, label string, v array<double>").withColumn("features", MO.dense_vector("v"))
    scores = lambda df: {(r.id, r["class"]): r.score for r in MO.class_scores(MO.fit("Boosted Trees", df, rounds=20, depth=3), rows, "Boosted Trees").collect()}
    one = scores(rows.coalesce(1))
    assert len(one) == 900 and scores(rows.repartition(7)) == one
    right = sum(one[i, label] == max(one[i, c] for c in ("low", "no", "yes")) for i, label, _ in data)
    assert right > 250
    model = MO.fit("Boosted Trees", rows, rounds=3, depth=2).stages[-1]
    model.write().save(str(tmp_path / "model"))
    loaded = B.BoostedModel.load(str(tmp_path / "model"))
    told = lambda m: [tuple(r) for r in m.transform(rows.coalesce(1)).select("id", "rawPrediction", "prediction").collect()]
    assert told(loaded) == told(model)
    with pytest.raises(ValueError):
        MO.fit("Boosted Trees", rows.withColumn("features", array_to_vector(F.transform("v", lambda x: F.when(x > 3, x).otherwise(float("nan"))))))


def test_more_than_a_task_holds_goes_through_spark(spark, monkeypatch):
    monkeypatch.setattr(B, "HELD", 100)
    x, y = made(60)
    rows = spark.createDataFrame([("yes" if b else "no", [float(v) for v in a]) for a, b in zip(x, y)], "label string, v array<double>").withColumn("features", MO.dense_vector("v"))
    model = MO.fit("Boosted Trees", rows, rounds=2, depth=2).stages[-1]
    assert [m.getNumTrees for m in model.models] == [2, 2]


def test_head_gbt_runs_all_rounds(spark, monkeypatch):
    from queuemill.plans.catalog import QUERIES

    def fit(head, train, **settings):
        raise Asked(head, settings)

    monkeypatch.setattr(MO, "fit", fit)
    with pytest.raises(Asked) as asked:
        QUERIES["head_gbt"](spark, SF)
    head, settings = asked.value.args
    trees = MO.HEADS[head][0](400, **settings)
    assert (trees.rounds, trees.depth) == (150, 6)


def test_select_head_tries_all_heads_and_settings(spark, monkeypatch):
    from queuemill import fixed
    from queuemill.plans.catalog import QUERIES
    asked = {}
    monkeypatch.setattr(MO, "cv_scores", lambda head, rows, settings: asked.setdefault(head, settings) and [0.5 + 0.01 * len(asked)] * len(settings))
    monkeypatch.setattr(MO, "knn_cv_scores", lambda rows, grid: asked.setdefault(MO.KNN, grid) and [0.1] * len(grid))
    got = {r.head: r.selected for r in QUERIES["select_head"](spark, SF).collect()}
    assert asked == {"Logistic Regression": [{"C": c} for c in (1.0, 3.0, 10.0, 30.0)], "Linear SVM": [{"C": c} for c in (0.3, 1.0, 3.0)],
                     "Random Forest": [{"min_leaf": n} for n in (1, 2)], "Boosted Trees": [{}], MO.KNN: list(fixed.KNN_GRID)}
    assert got == {**dict.fromkeys(asked, False), "Boosted Trees": True}
