"""Queries that fit models. Fitted numbers depend on the optimiser, so these have no SQL twin; the
vote and metric algebra after the scores is checked elsewhere."""

from pyspark.sql import functions as F

from queuemill import fixed
from queuemill.functions import scalars as S
from queuemill.operators import bundles as BU
from queuemill.operators import features as FE
from queuemill.operators import lexical as LX
from queuemill.operators import metrics as M
from queuemill.operators import models as MO
from queuemill.operators import retrieval as R
from queuemill.operators import sampling as SA
from queuemill.operators import votes as VO
from queuemill.plans import retrieval_queries as RQ
from queuemill.plans import views as V
from queuemill.plans.registry import query
from queuemill.plans.shared_frames import split
from queuemill.runtime import fresh_path, materialise, rounded, spread, table
from queuemill.streaming import jobs as J


def dense_rows(spark, sf, label="category"):
    rows = split(spark, sf).select(F.col("vec_id").alias("id"), F.col(label).alias("label"), "category", "team", "split", "fold",
                                   F.col("embedding").alias("vec"), MO.dense_vector("embedding").alias("features"))
    rows = materialise(rows, "dense-rows")
    return rows.where("split = 'train'"), rows.where("split = 'test'")


def sparse_rows(spark, sf):
    """Documents labelled by language, as TF-IDF vectors that are made when they are read."""
    docs = LX.tokens(spread(table(spark, sf, "documents")), "doc_id", RQ._clean(), "lang")
    placed = materialise(SA.stratified_split(docs, "lang", "doc_id"), "documents")
    vocabulary = LX.Vocabulary.fit(placed.where("split = 'train'"))
    size = max(1, vocabulary.terms.count())
    vectors = LX.vectors(placed, "doc_id", vocabulary)
    rows = placed.select("doc_id", "lang", "split", "fold").join(vectors, "doc_id")
    rows = rows.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), "split", "fold", "idx", "val")
    return rows, size


def shown(scores):
    return scores.select("id", "class", rounded(F.col("score"), 4).alias("score"), "score_kind")


@query("head_nb")
def head_nb(spark, sf):
    rows, size = sparse_rows(spark, sf)
    rows = MO.with_sparse_vectors(rows, size)
    model = MO.fit("Multinomial Naive Bayes", rows.where("split = 'train'"), alpha=0.1)
    return shown(MO.class_scores(model, rows.where("split = 'test'"), "Multinomial Naive Bayes"))


def _head_query(name, head, **settings):
    def run(spark, sf):
        train, test = dense_rows(spark, sf)
        return shown(MO.class_scores(MO.fit(head, train, **settings), test, head))
    query(name)(run)


_head_query("head_logreg", "Logistic Regression", C=1.0)
_head_query("head_svm", "Linear SVM", C=1.0)
_head_query("head_rf", "Random Forest")
_head_query("head_gbt", "Boosted Trees")


@query("svm_calibrated")
def svm_calibrated(spark, sf):
    train, test = dense_rows(spark, sf)
    return shown(MO.svm_calibrated(train, test))


@query("cv_score")
def cv_score(spark, sf):
    train, _ = dense_rows(spark, sf)
    score = MO.cv_score("Logistic Regression", train, C=1.0)
    return spark.createDataFrame([("Logistic Regression", score)], "head string, cv_f1 double")


@query("grid_tune")
def grid_tune(spark, sf):
    train, test = dense_rows(spark, sf)
    model, score, settings = MO.grid_tune("Logistic Regression", train)
    labels = MO.predict(model, test).select("id", "predicted")
    return labels.withColumns({"cv_f1": F.lit(score), "settings": F.lit(str(settings))})


@query("select_head")
def select_head(spark, sf):
    train, _ = dense_rows(spark, sf)
    return MO.select_head(train, {**{name: MO.HEADS[name][1] for name in MO.SELECTED}, MO.KNN: [{"n_neighbors": k} for k in fixed.KNN_GRID]})


def with_context(spark, sf):
    """Every vector and every document as a ticket, with its context blocks; a ticket without a vector has zeros."""
    both = ticket_rows(spark, sf).withColumnsRenamed({"id": "vec_id", "vector": "text", "category": "label"})
    fitter = FE.ContextBlocks.fit(both.where("split = 'train'"))
    blocks = materialise(fitter.transform(both).select("vec_id", "label", "split", "fold", "text", "dept", "time", "shape"), "blocks")
    return blocks


@query("ablate")
def ablate(spark, sf):
    train = with_context(spark, sf).where("split = 'train'")
    spec = [(name, list(blocks)) for name, blocks in fixed.ABLATION_STEPS[:-1]]
    return MO.ablate(train, spec, "Logistic Regression", {"C": 1.0})


@query("block_registry")
def block_registry(spark, sf):
    blocks = with_context(spark, sf)
    return FE.long_blocks(blocks.withColumnRenamed("vec_id", "ord"), list(FE.BLOCKS)).groupBy("block").agg(
        F.count(F.lit(1)).alias("cells"), F.count_distinct("dim").alias("dims"))


@query("oof_scores")
def oof_scores(spark, sf):
    train, _ = dense_rows(spark, sf)
    return shown(MO.oof_scores("Logistic Regression", train, C=1.0))


@query("cascade")
def cascade(spark, sf):
    train, test = dense_rows(spark, sf)
    routed = MO.cascade(train.drop("label"), test.drop("label"))
    return routed.select("id", "category", F.col("predicted").alias("team"), "confidence", "abstain", "score_kind")


@query("score_batch")
def score_batch(spark, sf):
    train, test = dense_rows(spark, sf)
    scored = MO.score_batch(MO.fit("Logistic Regression", train), test, "Logistic Regression")
    return scored.withColumn("ranking", F.array_join("ranking", ">"))


def ticket_rows(spark, sf):
    """Every vector and every document as a ticket: fields, vector, category, team, problem, resolution, split and fold."""
    cases = SA.stratified_split(V.cases(spark, sf), "category", "vec_id").drop("text")
    fields = V.tickets(spark, sf).select(F.col("ord").alias("t_ord"), "subject", "description", "department", "created")
    rows = cases.join(fields, F.col("vec_id") == F.col("t_ord"), "left").drop("t_ord")
    return materialise(rows.withColumnsRenamed({"vec_id": "id", "embedding": "vector"}), "ticket-rows")


def saved_bundle(spark, rows):
    """Fits the category and the routing job, and stores them with the corpus of solved tickets."""
    path, train = fresh_path(spark, "bundle"), rows.where("split = 'train'")
    category = BU.fit_category(train)
    BU.save_bundle(path, BU.fit_routing(train, category), train)
    return path


@query("save_model_bundle")
def save_model_bundle(spark, sf):
    rows = ticket_rows(spark, sf)
    path = saved_bundle(spark, rows)
    fresh = rows.where("split = 'test'").select("id", "subject", "description", "department", "created", "vector")
    return BU.load_pipeline(f"{path}/routing").transform(fresh).select(
        "id", F.col("category").alias("predicted"), rounded(F.col("category_confidence"), 4).alias("confidence"), F.col("team_suggested").alias("team"))


@query("answer_batch")
def answer_batch(spark, sf):
    """New tickets answered by a stored bundle: category, team, and solved tickets to look at."""
    rows = ticket_rows(spark, sf)
    path = saved_bundle(spark, rows)
    fresh = rows.where("split = 'test'").select("id", "subject", "description", "department", "created", "vector")
    shown = BU.answer(spark, path, fresh)
    return shown.select("id", "category", "team", "abstained", "category_filtered", "threshold", F.size("matches").cast("long").alias("n_matches"),
                        F.array_join(F.transform("matches", lambda m: m["candidate_id"].cast("string")), ",").alias("matched"),
                        F.exists("matches", lambda m: m["strong"]).alias("strong_match"))


@query("stream_scored_intake")
def stream_scored_intake(spark, sf):
    """Arriving tickets are scored by a stored bundle inside the stream; blank ones are set aside with the reason."""
    rows = ticket_rows(spark, sf)
    bundle = saved_bundle(spark, rows)
    arriving = rows.where("split = 'test'").select(
        F.col("id").alias("ord"), F.lit("2024-07-01 08:00:00").alias("at"), "subject", "description", F.lit("").alias("requester"), "department", "created", "vector")
    source, opened, events, rejected, checkpoint = (fresh_path(spark, t) for t in ("arrivals", "opened", "intake-events", "rejected", "checkpoint"))
    for part in ("ord % 2 = 0", "ord % 2 = 1"):
        arriving.where(part).write.mode("append").parquet(source)
        stream = J.read_stream(spark, source, arriving.schema, "parquet")
        J.stream_intake(stream, J.scores_of(BU.load_pipeline(f"{bundle}/routing")), opened, events, checkpoint, rejected_path=rejected).awaitTermination()
    told = spark.read.parquet(events).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("detail").alias("abstained"))
    aside = spark.read.parquet(rejected).groupBy(F.concat(F.lit("rejected "), F.col("reason")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("abstained"))
    return told.unionByName(aside)


@query("lsa_vectors")
def lsa_vectors(spark, sf):
    rows, size = sparse_rows(spark, sf)
    rows = materialise(rows, "sparse-rows")
    made, share = MO.lsa_vectors(rows.where("split = 'train'"), rows, size)
    return made.select("id", F.size("lsa").cast("long").alias("dims"), F.lit(share).alias("explained"))


@query("representation_test")
def representation_test(spark, sf):
    """Both tasks by the same head and folds on sentence vectors and on term vectors, over all training tickets."""
    cases = SA.stratified_split(V.cases(spark, sf), "category", "vec_id")
    words = LX.tokens(spread(cases), "vec_id", RQ._clean(), "split")
    vocabulary = LX.Vocabulary.fit(words.where("split = 'train'"))
    terms = materialise(LX.vectors(words, "vec_id", vocabulary).join(words.select("vec_id", "split"), "vec_id"), "term-vectors")
    lsa, _ = MO.lsa_vectors(terms.where("split = 'train'"), terms, max(1, vocabulary.terms.count()))
    both = cases.where("split = 'train'").join(lsa.select("vec_id", MO.array_to_vector("lsa").alias("lexical")), "vec_id").select(
        "category", "team", "fold", MO.dense_vector("embedding").alias("features"), "lexical")
    both = materialise(both, "representations")
    result = [(task, name, MO.cv_score("Logistic Regression", both.select(F.col(task).alias("label"), "fold", F.col(column).alias("features")), C=1.0))
              for task in ("category", "team") for name, column in (("Contextual sentence embedding", "features"), ("Lexical TF-IDF → LSA", "lexical"))]
    return spark.createDataFrame(result, "task string, representation string, cv_f1 double")


@query("fit_learning_curve")
def fit_learning_curve(spark, sf):
    train, test = dense_rows(spark, sf)
    runs = MO.learning_runs(train.select("id", "label", "features"), test, "Logistic Regression", C=1.0)
    return M.learning_curve(runs)
