"""The paths taken on large or skewed input, forced on small input and compared with brute force."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuemill.operators import ranking as RK
from queuemill.operators import sampling as SA
from queuemill.operators import similarity as SIM


def brute(queries, corpus, k, exclude=False, scopes=None, own=None):
    scores = np.round(queries @ corpus.T, 9)
    out = {}
    for i in range(len(queries)):
        ids = [j for j in range(len(corpus)) if not (exclude and i == j) and (own is None or own[i] is None or scopes[j] == own[i])]
        out[i] = sorted(ids, key=lambda j: (-scores[i, j], j))[:k]
    return out


def frame(spark, vectors, name, scope=None):
    return spark.createDataFrame([(i, v.tolist(), scope[i] if scope else None) for i, v in enumerate(vectors)], f"{name} long, v array<double>, s string")


@pytest.mark.parametrize("pivots,block", [(1, 4096), (1, 7), (6, 9), (25, 11)])
def test_topk_is_exact_with_a_hot_group_of_copies(spark, pivots, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    corpus = np.vstack([centres[i % 6] + 0.05 * rng.normal(size=12) for i in range(60)] + [centres[0]] * 30)
    queries = np.vstack([centres[i % 6] + 0.3 * rng.normal(size=12) for i in range(25)])
    got = SIM.topk(SIM.dense_queries(frame(spark, queries, "id"), "id", "v"), SIM.dense_corpus(frame(spark, corpus, "id"), "id", "v"),
                   7, pivots=pivots, block_rows=block).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.candidate_id)
    assert found == brute(queries, corpus, 7)


@pytest.mark.parametrize("pivots", [1, 5])
def test_topk_without_the_row_itself_and_within_scopes(spark, pivots):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(40, 6))
    scope = ["ab"[i % 2] for i in range(40)]
    asked = [scope[i] if i % 3 else None for i in range(40)]
    q = SIM.dense_queries(frame(spark, vectors, "id", asked), "id", "v", exclude="id", scope="s")
    c = SIM.dense_corpus(frame(spark, vectors, "id", scope), "id", "v", scope="s")
    found = {}
    for r in sorted(SIM.topk(q, c, 4, pivots=pivots, block_rows=8).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.candidate_id)
    assert found == brute(vectors, vectors, 4, True, scope, asked)


def test_pruning_skips_cells(spark):
    rng = np.random.default_rng(1)
    corpus = np.vstack([10 * np.eye(8)[i % 8] + 0.01 * rng.normal(size=8) for i in range(160)])
    c = SIM.dense_corpus(frame(spark, corpus, "id"), "id", "v")
    q = SIM.dense_queries(frame(spark, corpus[:8], "id"), "id", "v")
    asked, placed = SIM._by_pivot(q, c, [""], 3, 40)
    visited = asked.groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert visited < placed.select("cell").distinct().count()


def test_blocks_are_as_few_as_each_home_needs(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(300, 6))
    q, c = SIM.dense_queries(frame(spark, vectors, "id"), "id", "v"), SIM.dense_corpus(frame(spark, vectors[:50], "id"), "id", "v")
    asked, placed = SIM._placed(q, c, 3, 9, False)
    homes = {r["home"]: r["n"] for r in asked.select("home", "query_id").distinct().groupBy("home").agg(F.count("*").alias("n")).collect()}
    blocks = {r["home"]: r["n"] for r in SIM.query_blocks(asked, 20).groupBy("home").agg(F.countDistinct("qblock").alias("n")).collect()}
    assert all(blocks[h] <= -(-n // 20) for h, n in homes.items())


def test_bounds_are_computed_in_slices(spark, monkeypatch):
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["x"])
    assert max(b.num_rows * 50_000 for b in SIM._slices(batch, 50_000)) <= SIM.MOST
    assert sum(b.num_rows for b in SIM._slices(batch, 50_000)) == 1000
    monkeypatch.setattr(SIM, "MOST", 60)      # products in many steps
    rng = np.random.default_rng(2)
    a, b = (rng.normal(size=(17, 30)) * (rng.random((17, 30)) < 0.4) for _ in range(2))
    table = lambda m: SIM._Rows(pa.table({"idx": pa.array([np.nonzero(v)[0].tolist() for v in m], pa.list_(pa.int32())), "val": [v[np.nonzero(v)[0]].tolist() for v in m]}))
    assert np.allclose(SIM._products(table(a), table(b)), a @ b.T)


def test_many_scopes_need_no_bound(spark, monkeypatch):
    monkeypatch.setattr(SIM, "MAX_CELLS", 3)
    test_topk_without_the_row_itself_and_within_scopes(spark, 1)
    rng = np.random.default_rng(5)
    vectors, scope = rng.normal(size=(40, 6)), [f"s{i % 8}" for i in range(40)]
    asked = [scope[i] if i % 3 else None for i in range(40)]
    q = SIM.dense_queries(frame(spark, vectors, "id", asked), "id", "v", exclude="id", scope="s")
    c = SIM.dense_corpus(frame(spark, vectors, "id", scope), "id", "v", scope="s")
    found = {}
    for r in sorted(SIM.topk(q, c, 4, block_rows=8).collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.candidate_id)
    assert found == brute(vectors, vectors, 4, True, scope, asked)


def test_sparse_and_dense_agree(spark):
    rng = np.random.default_rng(2)
    dense = rng.normal(size=(30, 10)) * (rng.random((30, 10)) < 0.3)
    sparse = spark.createDataFrame([(i, np.nonzero(v)[0].tolist(), v[np.nonzero(v)[0]].tolist()) for i, v in enumerate(dense)],
                                   "id long, idx array<int>, val array<double>")
    from queuemill.operators import retrieval as R
    got = SIM.topk(R.sparse_queries(sparse, "id"), R.sparse_corpus(sparse, "id"), 5, sparse=True).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.candidate_id)
    assert found == brute(dense, dense, 5)


@pytest.mark.parametrize("segment", [1, 4, 1000])
def test_previous_value_over_segments(spark, segment):
    rng = np.random.default_rng(0)
    data = [(i, int(0 if rng.random() < 0.5 else rng.integers(1, 5)), None if rng.random() < 0.6 else f"t{i}") for i in range(200)]
    df = spark.createDataFrame(data, "event_id long, ticket_id long, team string")
    want = F.last("team", True).over(W.partitionBy("ticket_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1))
    got = RK.previous_value(df, "ticket_id", "event_id", F.col("team"), "before", segment)
    assert sorted(map(tuple, got.select("event_id", "before").collect())) == sorted(map(tuple, df.select("event_id", want).collect()))


def test_segmented_rank_equals_row_number(spark):
    df = spark.range(500).withColumn("label", F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")))
    df = df.withColumn("d", SA.digest(1, "id")).withColumn("label", F.when(F.col("id") != 7, F.col("label")))
    got = RK.segmented_rank(df, ["label"], RK.hash_segment(F.col("d"), 2), ["d", "id"], total="n")
    want = df.select("id", F.row_number().over(W.partitionBy("label").orderBy("d", "id")), F.count("*").over(W.partitionBy("label")))
    assert sorted(map(tuple, got.select("id", "rk", "n").collect())) == sorted(map(tuple, want.collect()))


def test_split_is_disjoint_complete_and_balanced(spark):
    df = spark.range(300).withColumn("label", (F.col("id") % 3).cast("string"))
    rows = SA.stratified_split(df, "label", "id").collect()
    assert len({r.id for r in rows}) == len(rows) == 300
    for label in "012":
        mine = [r for r in rows if r.label == label]
        assert sum(r.split == "test" for r in mine) == 20
        folds = [sum(r.fold == f for r in mine) for f in range(5)]
        assert max(folds) - min(folds) <= 1


def test_out_of_fold_rows_are_not_in_their_own_fit(spark):
    from queuemill.operators import models as MO
    # Every label is unique to its fold: a model that saw the row could name it, others cannot.
    data = [(i, f"only{i % 2}", [float(i % 2), 1.0], i % 2) for i in range(20)] + [(100 + i, "both", [5.0, float(i)], i % 2) for i in range(20)]
    rows = spark.createDataFrame(data, "id long, label string, v array<double>, fold long").withColumn("features", MO.dense_vector("v"))
    scores = MO.oof_scores("Logistic Regression", rows.select("id", "label", "features", "fold"), C=1.0, max_iter=10)
    seen = scores.where("id < 100").select((F.col("id") % 2).cast("string").alias("own"), "class").distinct().collect()
    assert seen and all(r["class"] != f"only{r.own}" for r in seen)


def test_term_basis_spans_the_leading_singular_vectors(spark):
    from queuemill.operators import models as MO
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(80, 5)) * [9, 7, 5, 3, 1]) @ rng.normal(size=(5, 20)) + 0.01 * rng.normal(size=(80, 20))
    rows = spark.createDataFrame([(list(range(20)), v.tolist()) for v in x], "idx array<int>, val array<double>").repartition(3)
    basis = MO.term_basis(rows, 20, 4)
    want = np.linalg.svd(x)[2][:4].T
    assert np.allclose(np.linalg.svd(basis.T @ want)[1], 1.0, atol=1e-6)


def test_ids_with_gaps_fill_few_segments(spark):
    from queuemill.operators import ranking as RK
    ids = [i ** 4 for i in range(200)]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    segments = df.select(RK.order_segment(df, "id", 20).alias("s"), "id").collect()
    assert len({r.s for r in segments}) <= 11
    assert [r.s for r in sorted(segments, key=lambda r: r.id)] == sorted(r.s for r in segments)
    ranked = RK.segmented_rank(df, [], RK.order_segment(df, "id", 20), ["id"])
    assert {r.id: r.rk for r in ranked.collect()} == {i: k + 1 for k, i in enumerate(ids)}


def test_a_query_travels_once_to_each_chunk(spark):
    rng = np.random.default_rng(8)
    corpus = rng.normal(size=(200, 8))      # no cell can be skipped
    c, q = SIM.dense_corpus(frame(spark, corpus, "id"), "id", "v"), SIM.dense_queries(frame(spark, corpus[:20], "id"), "id", "v")
    asked, placed = SIM._by_pivot(q, c, [""], 3, 40, 50)
    chunks = placed.select("seat").distinct().count()
    assert chunks == 4
    sent = asked.where("val is not null").select("query_id", "seat")
    assert sent.count() == sent.distinct().count() <= 20 * chunks < asked.count()
    assert asked.select("query_id", "seat").distinct().count() == sent.count()


def test_products_of_postings():
    rng = np.random.default_rng(9)
    sides = [rng.random((n, 60)) * (rng.random((n, 60)) < np.linspace(0.01, 0.6, 60)) for n in (15, 40)]
    rows = [SIM.sparse_rows(np.concatenate([[0], np.cumsum((m > 0).sum(axis=1))]), np.nonzero(m)[1], m[np.nonzero(m)]) for m in sides]
    held = SIM.Postings(rows[1])
    assert 0 < len(held.matrix) < len(held.terms)
    assert np.allclose(held.products(rows[0]), sides[0] @ sides[1].T, atol=1e-12)


@pytest.mark.parametrize("step", [3, 100])
def test_best_over_parts(step):
    scores = np.round(np.random.default_rng(10).random((6, 40)), 1)       # many ties
    scores[2] = -np.inf
    best = SIM.Best(6, 5)
    for low in range(0, 40, step):
        best.add(np.arange(6), scores[:, low:low + step], np.arange(40)[low:low + step])
    want = [(q, c, s) for q in range(6) for s, c in sorted((-s, c) for c, s in enumerate(scores[q]) if np.isfinite(s))[:5] for s in [-s]]
    assert list(zip(best.row.tolist(), best.ids.tolist(), best.scores.tolist())) == want


def test_no_vector_is_shuffled_for_a_pair(spark):
    rng = np.random.default_rng(9)
    corpus = rng.normal(size=(200, 8))
    c, q = SIM.dense_corpus(frame(spark, corpus, "id"), "id", "v"), SIM.dense_queries(frame(spark, corpus[:60], "id"), "id", "v")
    for found, asked, placed in ((SIM._seated, *SIM._by_pivot(q, c, [""], 3, 40, 50)), (SIM._partial, *SIM._by_scope(q, c))):
        pairs = found(asked, placed, 3, 20)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan
        assert SIM.ranked(pairs, 3).count() == 60 * 3


def test_blocks_and_chunks_are_packed_whole():
    import pyarrow as pa
    batches = [pa.RecordBatch.from_pydict({"q_query_id": pa.array([10 * b + i for i in range(n)], pa.int64()), "q_looks": pa.array([[b, i] for i in range(n)], pa.list_(pa.int64()))})
               for b, n in enumerate((7, 0, 5, 1))]
    blocks = list(SIM._pack_blocks(4)(iter(batches)))
    rows = [SIM._unpacked(b.column("q_rows")[0]).to_pylist() for b in blocks]
    assert [len(r) for r in rows] == [4, 4, 4, 1]
    assert sum(rows, []) == pa.Table.from_batches(batches).to_pylist()
    assert [sorted(b.column("q_looks")[0].as_py()) for b in blocks] == [sorted({x for r in some for x in r["q_looks"]}) for some in rows]


def test_an_optimiser_goes_through_few_partitions(spark, monkeypatch):
    from queuemill.operators import models as MO
    rows = spark.range(400).select("id", (F.col("id") % 2).cast("string").alias("label"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v")).repartition(16)
    rows = rows.select("id", "label", MO.dense_vector("v").alias("features"))
    parts = lambda head: MO.for_passes(head, rows, 400).rdd.getNumPartitions()
    assert parts("Linear SVM") == parts("Logistic Regression") == 1 and parts("Random Forest") == 16
    monkeypatch.setattr(MO, "PART_BYTES", 1000)     # 400 rows of 2 numbers, 12 bytes each
    assert parts("Linear SVM") == 10 and MO.for_passes("Linear SVM", rows, 400).count() == 400
    assert MO.for_passes("Linear SVM", rows.where("false"), 0).count() == 0


def test_tickets_are_ranked_by_many_tasks(spark):
    from queuemill.operators import lifecycle as L
    arrivals = spark.range(50_000).select((F.col("id") * 1).alias("ord"), F.lit("s").alias("subject"), F.repeat(F.lit("d"), 3000).alias("description"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        opened = L.open_tickets(arrivals, 7)
        parts = opened.groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) > 1 and max(r["count"] for r in parts) < 40_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert opened.where((F.col("id") != F.col("ord") + 8) | (F.length("description") != 2000)).count() == 0


def test_label_codes_screen_once(spark):
    from queuemill.plans.catalog import QUERIES
    plan = QUERIES["label_codes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan


def test_boosting_goes_through_few_partitions(spark):
    from queuemill.operators import models as MO
    rows = spark.range(400).select("id", (F.col("id") % 2).cast("string").alias("label"), F.array(F.col("id").cast("double")).alias("v"))
    rows = rows.withColumn("features", MO.dense_vector("v"))
    cores = spark.sparkContext.defaultParallelism
    parts = lambda n: MO.for_passes("Boosted Trees", rows.repartition(n), 400).rdd.getNumPartitions()
    assert parts(5 * cores) == cores and parts(2) == 2      # draws of few partitions stay
    assert MO.for_passes("Boosted Trees", rows.repartition(5 * cores), 400).count() == 400


def test_naive_bayes_sends_no_rows_to_their_class(spark, monkeypatch):
    from queuemill.operators import models as MO
    data = [(f"c{i % 3}" if i % 10 else None, [float(i % 7), 1.0 + i % 3, float(i % 3)]) for i in range(90)]
    rows = spark.createDataFrame(data, "label string, v array<double>").withColumn("features", MO.dense_vector("v"))
    seen = []
    real = MO.for_passes
    monkeypatch.setattr(MO, "for_passes", lambda head, df, n: seen.append(df) or real(head, df, n))
    model = MO.fit("Multinomial Naive Bayes", rows, alpha=0.5)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert MO.classes(model) == ["c0", "c1", "c2"]
    for k, name in enumerate(MO.classes(model)):
        mine = np.array([v for label, v in data if label == name])
        share = (mine.sum(axis=0) + 0.5) / (mine.sum() + 1.5)
        assert np.allclose(np.array(model.stages[-1].theta.toArray())[k], np.log(share))
        assert np.isclose(model.stages[-1].pi.toArray()[k], np.log((len(mine) + 0.5) / (81 + 1.5)))


def test_latent_vectors_and_their_share_from_few_sums(spark):
    from queuemill.operators import models as MO
    rng = np.random.default_rng(6)
    x = rng.random((120, 30)) * (rng.random((120, 30)) < 0.3)
    x[:3] = 0       # without known terms
    data = [(i, np.flatnonzero(v).tolist(), v[v > 0].tolist()) for i, v in enumerate(x)]
    cores = spark.sparkContext.defaultParallelism
    rows = spark.createDataFrame(data, "id long, idx array<int>, val array<double>").repartition(5 * cores)
    assert MO._for_sums(rows).rdd.getNumPartitions() == 2 * cores
    made, share = MO.lsa_vectors(rows, rows, 30, 4)
    assert made.columns == ["id", "lsa"]
    basis = MO.term_basis(rows, 30, 4)
    raw = x @ basis
    assert np.isclose(share, raw.var(axis=0).sum() / x.var(axis=0).sum())
    found = {r.id: r.lsa for r in made.collect()}
    assert sorted(found) == list(range(120)) and not np.any(found[0])
    assert np.allclose([found[i] for i in range(3, 120)], raw[3:] / np.linalg.norm(raw[3:], axis=1, keepdims=True))


def test_terms_of_documents_are_named_whole():
    import pyarrow as pa
    from queuemill.operators import lexical as LX
    docs = [["b", "a", "b", "a"], [], ["a"], ["c", "c", "c"]]
    batch = pa.RecordBatch.from_arrays([pa.array(docs, pa.list_(pa.string()))], names=["words"])
    (_, row, code, names), = LX._slices([batch], 0)
    rows, terms, counts = LX._terms(row, code, names)
    got = sorted(zip(rows.tolist(), LX._named(terms, names).to_pylist(), counts.tolist()))
    assert got == [(0, "a", 2), (0, "a b", 1), (0, "b", 2), (0, "b a", 2), (2, "a", 1), (3, "c", 3), (3, "c c", 2)]
    assert len(LX._named(np.zeros(0, np.int64), pa.array([], pa.string()))) == 0


def test_term_vectors_are_written_once(spark, monkeypatch):
    from queuemill.operators import models as MO
    from queuemill.plans import model_queries as Q
    rows = spark.createDataFrame([(1, [0, 3], [1.0, 2.0]), (2, [], [])], "id long, idx array<int>, val array<double>")
    made = MO.with_sparse_vectors(rows, 5)
    assert made.columns == ["id", "features"]
    assert {r.id: r.features.toArray().tolist() for r in made.collect()} == {1: [1.0, 0, 0, 2.0, 0], 2: [0.0] * 5}
    tags = []
    real = Q.materialise
    monkeypatch.setattr(Q, "materialise", lambda df, tag: tags.append(tag) or real(df, tag))
    Q.sparse_rows(spark, "/root/testdata/sf0.001")
    assert tags == ["documents"]
