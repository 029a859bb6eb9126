"""Hard negatives against brute force over all pairs, with chunks, packs, ties, huge numbers and edge rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from queuemill.llm import hard_negatives as H


def brute(rows, positives, negatives, is_anchor):
    whole = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(256 * x) for x in vector):
            continue
        whole.append((vec_id, [int(math.floor(256 * x)) for x in vector], label))
    dot = lambda a, b: max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
    out = []
    for own, v, label in {(i, tuple(v), g) for i, v, g in whole if is_anchor(i)}:
        scored = sorted((-dot(v, w), i, g) for i, w, g in whole)
        first = [(i, -s) for s, i, g in scored if g == label and i != own][:positives]
        for pos, ps in first:
            good = [(i, -s) for s, i, g in scored if g != label and 30 * ps <= -100 * s <= 90 * ps][:negatives]
            out += [(own, pos, n, i, ps, s) for n, (i, s) in enumerate(good, 1)]
    return sorted(out)


DDL = "vec_id long, embedding array<double>, label int, score double, key long, pack int"


def mined(spark, rows, every=10):
    df = spark.createDataFrame([(*r, 0.0, 1, 1) for r in rows], DDL).repartition(3)
    return sorted(tuple(r) for r in H.mine(H.whole_vectors(df), F.col("vec_id") % every == 0, 3, 4).collect())


def cloud(rnd, n, dims, labels):
    rows = []
    for i in range(n):
        label = rnd.randrange(labels)
        middle = [math.cos(label * (d + 1)) for d in range(dims)]
        rows.append((i, [round(m + rnd.gauss(0, 0.5), 2) for m in middle], label))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:       # many chunks, and clusters of several packs
        monkeypatch.setattr(H, "CHUNK", 400)
        monkeypatch.setattr(H, "PACK", 40)
        monkeypatch.setattr(H, "MEMBERS", 20)
    rows = cloud(random.Random(2), 400, 8, 3)
    rows += [(400 + i, rows[30][1], 1) for i in range(150)]      # a large group of copies of an anchor
    assert mined(spark, rows) == brute(rows, 3, 4, lambda i: i % 10 == 0)


def test_edges(spark):
    rows = [(0, [1.0, 2.0], 0), (0, [1.0, 2.0], 0), (1, [1.0, 2.0, 3.0], 0), (2, [0.5], 1), (3, [], 1), (4, [0.0, 0.0], 1), (10, [0.0, 0.0], 0), (20, [-1.0, 1.0], 2),
            (5, None, 1), (6, [1.0, None], 1), (7, [float("nan"), 1.0], 1), (8, [float("inf")], 1), (None, [1.0], 1), (9, [1.0, 1.0], None), (11, [0.9, 1.0], 1),
            (12, [1e18, 1.0], 0), (13, [3e17, 5.0], 1), (30, [1e18, 1e18], 1), (-10, [1.0, 0.3], 1), (14, [1.7e308], 1), (15, [0.4, 0.4], 2), (16, [0.6, 0.6], 1)]
    assert mined(spark, rows) == brute(rows, 3, 4, lambda i: i % 10 == 0)
    assert mined(spark, [r for r in rows if r[0] is None or r[0] % 10]) == []
    assert H.mine(H.whole_vectors(spark.createDataFrame([], DDL)), F.col("vec_id") % 10 == 0).count() == 0


def test_the_walk_stops_before_the_end():
    rnd = np.random.default_rng(0)
    middle = np.zeros(16)
    middle[0] = 1.0
    near, far = middle + rnd.normal(0, 0.02, (200, 16)), rnd.normal(0, 1, (20_000, 16))
    rows = np.floor(256 * np.concatenate([near, far / np.linalg.norm(far, axis=1)[:, None]]))
    anchors, ids = np.floor(256 * (middle + rnd.normal(0, 0.02, (50, 16)))), np.arange(len(rows))
    best = H.Best(50, 5)

    def offer(active, part, scores):
        for i, row in zip(active, scores):
            best.add(i, row, ids[part])

    scored = H.walk(anchors, middle, rows, ids, lambda active: np.array([float(best.worst(i)) for i in active]), offer)
    exact = anchors @ rows.T
    for i in range(50):
        want = sorted((-int(s), d) for d, s in enumerate(exact[i]))[:5]
        assert [(-s, d) for s, d in best.held[i]] == want
    assert scored < 0.1 * exact.size
