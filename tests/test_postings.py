"""The pruned inverted index equals brute force, and most of it is not read."""

import numpy as np
import pytest

from queuemill.operators import postings as P
from queuemill.operators import retrieval as R
from queuemill.operators import similarity as SIM


def corpus_of(rng, n, terms=400, topics=8, own=12):
    """Unit vectors over the terms of a topic and a few common ones; some are copies, some are empty."""
    out = np.zeros((n, terms))
    for i in range(n):
        topic = i % topics
        mine = rng.choice(np.arange(topic * 45, topic * 45 + 45), own, replace=False)
        out[i, mine] = rng.random(own) + 0.5
        out[i, rng.choice(np.arange(360, 400), 4, replace=False)] = 0.1
    out[n // 2:n // 2 + n // 4] = out[3]
    out[7] = 0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def frame(spark, vectors, first=0):
    rows = [(first + i, np.flatnonzero(v).tolist(), v[np.flatnonzero(v)].tolist()) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, idx array<int>, val array<double>").repartition(3)


def brute(queries, corpus, k, first=0, without_self=False):
    scores = np.round(queries @ corpus.T, 9) + 0.0
    if without_self:
        np.fill_diagonal(scores, -1)
    return {first + q: sorted(((-s, c) for c, s in enumerate(row) if s >= 0))[:k] for q, row in enumerate(scores)}


def test_products_of_meeting_entries(monkeypatch):
    rng = np.random.default_rng(7)
    sides = [corpus_of(rng, n) for n in (30, 40)]
    rows = [SIM.sparse_rows(np.concatenate([[0], np.cumsum((m > 0).sum(axis=1))]), np.nonzero(m)[1], m[np.nonzero(m)]) for m in sides]
    for most, work in ((4_000_000, 0), (17, 0), (50, 10**9)):
        monkeypatch.setattr(SIM, "MOST", most)
        monkeypatch.setattr(SIM, "SPARSE", work)
        assert np.allclose(SIM._products(*rows), sides[0] @ sides[1].T, atol=1e-12)


@pytest.mark.parametrize("block, pivots, pack", [(4096, None, 4_000_000), (7, 5, 60), (30, 1, 4_000_000)])
def test_against_brute_force(spark, monkeypatch, block, pivots, pack):
    monkeypatch.setattr(P, "PACK", pack)
    monkeypatch.setattr(P, "QUERIES", 9)
    rng = np.random.default_rng(1)
    held, asked = corpus_of(rng, 120), np.vstack([corpus_of(rng, 25), np.zeros((1, 400))])
    got = {}
    for r in P.topk(R.sparse_queries(frame(spark, asked, 1000), "id"), R.sparse_corpus(frame(spark, held), "id"), 6, pivots, block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.candidate_id))
    assert {q: [x[1:] for x in sorted(rows)] for q, rows in got.items()} == brute(asked, held, 6, 1000)


def test_without_the_row_itself(spark):
    held = corpus_of(np.random.default_rng(2), 60)
    got = {}
    for r in P.topk(R.sparse_queries(frame(spark, held), "id", exclude="id"), R.sparse_corpus(frame(spark, held), "id"), 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.candidate_id))
    assert {q: [x[1:] for x in sorted(rows)] for q, rows in got.items()} == brute(held, held, 4, without_self=True)


def test_empty_sides(spark):
    some, none = frame(spark, corpus_of(np.random.default_rng(3), 12)), frame(spark, np.zeros((0, 4)))
    assert P.topk(R.sparse_queries(some, "id"), R.sparse_corpus(none, "id"), 3).count() == 0
    assert P.topk(R.sparse_queries(none, "id"), R.sparse_corpus(some, "id"), 3).count() == 0
    assert P.topk(R.sparse_queries(some, "id"), R.sparse_corpus(some.where("id = 7"), "id"), 3).count() == 12     # a document without terms


def test_most_cells_and_most_documents_are_skipped(spark, monkeypatch):
    seen = []
    keep = P._looked_into

    def counted(asked, placed, k, block):
        sizes = placed.groupBy("cell").count().withColumnRenamed("count", "n")
        seen.append(asked.join(sizes, "cell").agg({"n": "sum"}).first()[0] or 0)
        return keep(asked, placed, k, block)

    monkeypatch.setattr(P, "_looked_into", counted)
    monkeypatch.setattr(P, "PROBE", 1)
    rng = np.random.default_rng(4)
    held, asked = corpus_of(rng, 800), corpus_of(rng, 100)
    P.topk(R.sparse_queries(frame(spark, asked), "id"), R.sparse_corpus(frame(spark, held), "id"), 3, pivots=60).count()
    assert len(seen) == 2 and sum(seen) < 0.35 * len(held) * len(asked)


def test_terms_that_cannot_reach_the_floor_open_no_postings():
    rng = np.random.default_rng(5)
    held = corpus_of(rng, 300)
    rows = [np.flatnonzero(v) for v in held]
    chunk = P.Chunk(np.arange(300), np.cumsum([0, *map(len, rows)]), np.concatenate(rows), np.concatenate([v[r] for v, r in zip(held, rows)]))
    v = held[10]
    index = np.flatnonzero(v)
    asked = SIM.sparse_rows(np.array([0, len(index)]), index, v[index])
    _, ids, scores = chunk.best(asked, np.array([-1]), np.array([0.9]), 5)
    want = sorted((-s, i) for i, s in enumerate(np.round(held @ v, 9)) if s >= 0.9 - SIM.SLACK)[:5]
    assert [(-s, i) for i, s in zip(ids, scores)] == want
    assert chunk.scored < 80


def test_blends_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    sparse, dense = corpus_of(rng, 50), rng.normal(size=(50, 5))
    dense[4] = 0
    rows = frame(spark, sparse)
    both = rows.join(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(dense) if i != 4], "id long, embedding array<double>"), "id", "left")
    weights = [0.0, 0.3, 1.0]
    got = {(r.w, r.query_id): (r.candidate_id, r.score) for r in R.leave_one_out(both, weights, "id").collect()}
    for w in weights:
        scores = np.round(w * (dense @ dense.T) + (1 - w) * (sparse @ sparse.T), 9) + 0.0
        np.fill_diagonal(scores, -np.inf)
        for q in range(50):
            s, c = min((-s, c) for c, s in enumerate(scores[q]))
            assert got[w, q] == (c, -s)
