"""Queries over class scores, votes and evaluation tables, each with its check."""

from functools import reduce

from pyspark.sql import functions as F

from queuemill import fixed
from queuemill.operators import features as FE
from queuemill.operators import metrics as M
from queuemill.operators import retrieval as R
from queuemill.operators import screening as SC
from queuemill.operators import similarity as SIM
from queuemill.operators import votes as VO
from queuemill.plans import retrieval_queries as RQ
from queuemill.plans import screening_queries as SQ
from queuemill.plans import views as V
from queuemill.plans.registry import query, with_ctes
from queuemill.plans.shared_frames import split
from queuemill.runtime import materialise, ratio, rounded

KEYS = ["ticket_id", "actual"]
CLASSES = [f"cat_{i}" for i in range(10)]
MODELS = [f"m{i}" for i in range(5)]


def scores(spark, sf):
    """Scores of five models for every vector, derived from its id and label."""
    base = V.vectors(spark, sf).select("vec_id", "category", "pid")
    label = F.substring("category", 5, 9).cast("long")
    grid = base.withColumn("class_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    grid = grid.withColumn("m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    v, c, m = F.col("vec_id"), F.col("class_index"), F.col("m")
    raw = ((v * 7919 + c * 104729 + m * 1299709 + (v % 37) * (c * 13 + m * 7)) % 1000) / 1000
    bonus = F.when((c == label) & ((v * 31 + m * 17) % 10 < 6), 0.6).otherwise(0.0)
    return grid.select(v.alias("ticket_id"), F.col("category").alias("actual"), F.concat(F.lit("m"), m.cast("string")).alias("model"),
                       F.concat(F.lit("cat_"), c.cast("string")).alias("class"), "class_index", (raw + bonus).alias("score"))


SCORES = ("fs", """
SELECT vec_id AS ticket_id, category AS actual, 'm' || m AS model, 'cat_' || c AS class, c AS class_index,
  ((vec_id * 7919 + c * 104729 + m * 1299709 + (vec_id % 37) * (c * 13 + m * 7)) % 1000) / 1000
  + CASE WHEN 'cat_' || c = category AND (vec_id * 31 + m * 17) % 10 < 6 THEN 0.6::DOUBLE ELSE 0 END AS score
FROM vx, (SELECT unnest(range(10)) AS c), (SELECT unnest(range(5)) AS m)""")
NORM = ("ns", "SELECT * REPLACE (score / sum(score) OVER (PARTITION BY ticket_id, model) AS score) FROM fs")
BRANCH = ("br", """SELECT ticket_id, actual, model, class AS predicted, class_index FROM (
  SELECT *, row_number() OVER (PARTITION BY ticket_id, model ORDER BY round(score, 12) DESC, class_index) AS r FROM ns) WHERE r = 1""")
SOFT = ("soft", "SELECT ticket_id, actual, class, class_index, avg(score) AS score FROM ns GROUP BY ALL")
WEIGHTS = ("wg", "SELECT model, w / sum(w) OVER () AS w FROM (SELECT model, round(avg(CASE WHEN predicted = actual THEN 1.0 ELSE 0.0 END), 4) AS w FROM br GROUP BY model)")
WEIGHTED = ("wtd", "SELECT ticket_id, actual, class, class_index, sum(w * score) AS score FROM ns JOIN wg USING (model) GROUP BY ALL")
MAJORITY = ("maj", "SELECT ticket_id, actual, predicted AS class, class_index, count(*) / 5.0::DOUBLE AS score FROM br GROUP BY ALL")


def best_sql(source):
    return f"""SELECT ticket_id, actual, class AS predicted, score AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY round(score, 12) DESC, class_index) AS r FROM {source}) WHERE r = 1"""


VOTES = [V.VECTORS, SCORES, NORM, BRANCH, SOFT, WEIGHTS, WEIGHTED, MAJORITY]
COMBINED = ("COMBINED (soft vote)", "COMBINED (weighted vote)", "COMBINED (majority vote)")
PREDICTIONS = [*VOTES, ("cb", " UNION ALL ".join(
    f"SELECT '{n}' AS model, 'ensemble' AS role, ticket_id, actual, predicted FROM ({best_sql(s)})" for n, s in zip(COMBINED, ("soft", "wtd", "maj")))
    + " UNION ALL SELECT model, 'individual', ticket_id, actual, predicted FROM br"),
    ("pd", f"""SELECT '{fixed.CLASSIFICATION}' AS task, model, role, ticket_id, actual, predicted FROM cb
UNION ALL SELECT '{fixed.ROUTING}', model, role, ticket_id, 'team_' || (substring(actual, 5)::BIGINT % 7), 'team_' || (substring(predicted, 5)::BIGINT % 7) FROM cb""")]


def normalised_scores(spark, sf):
    return VO.normalised(scores(spark, sf), [*KEYS, "model"])


def branch_labels(normal):
    return VO.argmax_class(normal, [*KEYS, "model"]).select(*KEYS, "model", "predicted")


def branch_weights(normal):
    """Model parameters: one number per branch."""
    hit = F.avg((F.col("predicted") == F.col("actual")).cast("double"))
    return {r.model: r.w for r in branch_labels(normal).groupBy("model").agg(rounded(hit, 4).alias("w")).collect()}


def predictions(spark, sf):
    normal = materialise(normalised_scores(spark, sf), "scores")
    label = lambda df: VO.argmax_class(df, KEYS).select(*KEYS, "predicted")
    named = lambda df, model, role: df.select(F.lit(model).alias("model") if model else F.col("model"), F.lit(role).alias("role"), *KEYS, "predicted")
    parts = [named(label(VO.soft_vote(normal, KEYS)), COMBINED[0], "ensemble"),
             named(label(VO.weighted_vote(normal, branch_weights(normal), KEYS)), COMBINED[1], "ensemble"),
             named(label(VO.majority_vote(normal, KEYS)), COMBINED[2], "ensemble"),
             named(branch_labels(normal), None, "individual")]
    every = reduce(lambda a, b: a.unionByName(b), parts)
    team = lambda c: F.concat(F.lit("team_"), (F.substring(c, 5, 9).cast("long") % 7).cast("string"))
    both = F.explode(F.array(
        F.struct(F.lit(fixed.CLASSIFICATION).alias("task"), F.col("actual"), F.col("predicted")),
        F.struct(F.lit(fixed.ROUTING).alias("task"), team("actual").alias("actual"), team("predicted").alias("predicted"))))
    return materialise(every.select("model", "role", "ticket_id", both.alias("t")).select("t.task", "model", "role", "ticket_id", "t.actual", "t.predicted"), "predictions")


# ---------------------------------------------------------------- scores and votes

@query("align_classes", with_ctes([V.VECTORS, SCORES], """
SELECT ticket_id, model, class, class_index, round(CASE WHEN class_index > 1 THEN score ELSE 0 END, 6) AS score FROM fs"""))
def align_classes(spark, sf):
    known = scores(spark, sf).where("class_index > 1").drop("class_index")
    aligned = VO.align_classes(known, CLASSES, ["ticket_id", "model"])
    return aligned.withColumn("score", rounded(F.col("score")))


@query("softmax_margin", with_ctes([V.VECTORS, SCORES], """
SELECT ticket_id, model, class, round(exp(score - max(score) OVER w) / sum(exp(score)) OVER w * exp(max(score) OVER w), 6) AS score, 'margin' AS score_kind
FROM fs WINDOW w AS (PARTITION BY ticket_id, model)"""))
def softmax_margin(spark, sf):
    soft = VO.softmax_scores(scores(spark, sf), ["ticket_id", "model"])
    return soft.select("ticket_id", "model", "class", rounded(F.col("score")).alias("score"), "score_kind")


@query("argmax_class", with_ctes([V.VECTORS, SCORES, NORM, ("rk", """
SELECT *, row_number() OVER (PARTITION BY ticket_id, model ORDER BY round(score, 12) DESC, class_index) AS r FROM ns""")], """
SELECT ticket_id, model, max(class) FILTER (r = 1) AS predicted, round(max(score) FILTER (r = 1), 6) AS confidence,
  max(class) FILTER (r = 2) AS runner_up, round(max(score) FILTER (r = 2), 6) AS runner_up_confidence,
  string_agg(class, '>' ORDER BY r) AS ranking FROM rk GROUP BY ALL"""))
def argmax_class(spark, sf):
    best = VO.argmax_class(normalised_scores(spark, sf), ["ticket_id", "model"])
    return best.withColumns({"ranking": F.array_join("ranking", ">"), "confidence": rounded(F.col("confidence")),
                             "runner_up_confidence": rounded(F.col("runner_up_confidence"))})


def _vote_query(name, cte, run):
    query(name, with_ctes(VOTES, f"SELECT ticket_id, class, round(score, 6) AS score FROM {cte}"))(
        lambda spark, sf: run(normalised_scores(spark, sf)).select("ticket_id", "class", rounded(F.col("score")).alias("score")))


_vote_query("soft_vote", "soft", lambda n: VO.soft_vote(n, KEYS))
_vote_query("weighted_vote", "wtd", lambda n: VO.weighted_vote(n, branch_weights(n), KEYS))
_vote_query("majority_vote", "maj", lambda n: VO.majority_vote(n, KEYS))

AGREE = [*VOTES, ("sb", best_sql("soft")), ("ag", """
SELECT sb.*, (SELECT avg(CASE WHEN br.predicted = sb.predicted THEN 1.0 ELSE 0.0 END) FROM br WHERE br.ticket_id = sb.ticket_id) AS agreement FROM sb""")]


def agreed(spark, sf):
    normal = normalised_scores(spark, sf)
    return VO.vote_agreement(normal, VO.argmax_class(VO.soft_vote(normal, KEYS), KEYS), KEYS)


@query("vote_agreement", with_ctes(AGREE, "SELECT ticket_id, predicted, round(agreement, 2) AS agreement FROM ag"))
def vote_agreement(spark, sf):
    return agreed(spark, sf).select("ticket_id", "predicted", rounded(F.col("agreement"), 2).alias("agreement"))


@query("abstain_route", with_ctes(AGREE, f"""
SELECT ticket_id, proposed, abstain, CASE WHEN abstain THEN '{fixed.FIRST_LINE}' ELSE proposed END AS team, agreement_abstain FROM (
  SELECT ticket_id, predicted AS proposed, round(confidence, 9) < 0.15 AS abstain, round(agreement, 2) < 0.8 AS agreement_abstain FROM ag)"""))
def abstain_route(spark, sf):
    voted = agreed(spark, sf).withColumns({"confidence": rounded(F.col("confidence"), 9), "agreement": rounded(F.col("agreement"), 2)})
    routed = VO.abstain_route(voted, 0.15)
    declined = VO.abstain_on_disagreement(voted).select("ticket_id", F.col("abstain").alias("agreement_abstain"))
    return routed.join(declined, "ticket_id").select("ticket_id", "proposed", "abstain", "team", "agreement_abstain")


@query("agreement_accuracy", with_ctes([*AGREE, ("lv", """
SELECT round(agreement, 2) AS agreement, count(*) AS n, count(*) FILTER (predicted = actual) AS ok FROM ag GROUP BY 1""")], """
SELECT agreement, n, round(ok::DOUBLE / n, 4) AS accuracy,
  round((SELECT sum(n) FROM lv WHERE agreement >= 0.8)::DOUBLE / (SELECT sum(n) FROM lv), 4) AS coverage_at_threshold,
  round((SELECT sum(ok) FROM lv WHERE agreement >= 0.8)::DOUBLE / (SELECT sum(n) FROM lv WHERE agreement >= 0.8), 4) AS accuracy_at_threshold FROM lv"""))
def agreement_accuracy(spark, sf):
    return M.agreement_accuracy(agreed(spark, sf))


_GRID = ", ".join(f"({t}::DOUBLE)" for t in fixed.ABSTAIN_GRID)


@query("abstention_curve", with_ctes([*VOTES, ("sb", f"SELECT * REPLACE (round(confidence * 2, 9) AS confidence) FROM ({best_sql('soft')})")], f"""
SELECT t AS threshold, round(100.0::DOUBLE * count(*) FILTER (confidence >= t) / count(*), 1) AS answered_pct,
  round(avg(CASE WHEN predicted = actual THEN 1.0 ELSE 0.0 END) FILTER (confidence >= t), 4) AS accuracy_answered,
  round(avg(CASE WHEN predicted = actual THEN 1.0 ELSE 0.0 END) FILTER (confidence < t), 4) AS accuracy_declined,
  round(100 * avg(CASE WHEN actual = 'cat_3' THEN 1.0 ELSE 0.0 END) FILTER (confidence < t), 1) AS first_line_pct,
  round(avg(CASE WHEN actual = 'cat_3' THEN 1.0 ELSE 0.0 END) FILTER (confidence < t) / avg(CASE WHEN actual = 'cat_3' THEN 1.0 ELSE 0.0 END), 2) AS enrichment
FROM sb, (VALUES {_GRID}) g(t) GROUP BY t"""))
def abstention_curve(spark, sf):
    best = VO.argmax_class(VO.soft_vote(normalised_scores(spark, sf), KEYS), KEYS)
    return M.abstention_curve(best.withColumn("confidence", rounded(F.col("confidence") * 2, 9)), "cat_3")


@query("oof_agreement", with_ctes(VOTES, """
SELECT round(avg(CASE WHEN predicted = actual THEN 1.0 ELSE 0.0 END), 4) AS agreement FROM br WHERE model = 'm0'"""))
def oof_agreement(spark, sf):
    labels = branch_labels(normalised_scores(spark, sf).where("model = 'm0'"))
    return labels.agg(rounded(F.avg((F.col("predicted") == F.col("actual")).cast("double")), 4).alias("agreement"))


@query("cascade_join", with_ctes([V.VECTORS, SCORES], """
SELECT vec_id, class_index AS dim, round(score, 6) AS value FROM vx JOIN fs ON ticket_id = vec_id WHERE model = 'm0'"""))
def cascade_join(spark, sf):
    upstream = scores(spark, sf).where("model = 'm0'").withColumnRenamed("ticket_id", "vec_id")
    joined = VO.cascade_join(V.vectors(spark, sf).select("vec_id"), upstream, "vec_id")
    return SQ.long_array(joined, "vec_id", F.col("cat"))


CAT_BLOCK = [V.VECTORS, V.SPLIT, SCORES,
             ("cj", "SELECT vec_id, split, class_index AS dim, score AS x FROM sp JOIN fs ON ticket_id = vec_id WHERE model = 'm0'"),
             ("fit", "SELECT dim, avg(x) AS mean, stddev_pop(x) AS std FROM cj WHERE split = 'train' GROUP BY dim"),
             ("sx", "SELECT vec_id, dim, (x - mean) / std AS x FROM cj JOIN fit USING (dim)")]


@query("category_block", with_ctes(CAT_BLOCK, """
SELECT vec_id, dim, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-9), 6) + 0.0 AS value FROM sx"""))
def category_block(spark, sf):
    upstream = scores(spark, sf).where("model = 'm0'").withColumnRenamed("ticket_id", "vec_id")
    joined = VO.cascade_join(split(spark, sf).select("vec_id", "split"), upstream, "vec_id")
    fitter = FE.ContextBlocks([], {}).fit_extra("cat", joined.where("split = 'train'"))
    return SQ.long_array(fitter.apply_extra("cat", joined), "vec_id", F.col("cat"))


@query("balanced_weights", """
SELECT lang, count(*) AS n, round((SELECT count(*) FROM documents)::DOUBLE / ((SELECT count(DISTINCT lang) FROM documents) * count(*)), 6) AS weight
FROM documents GROUP BY lang""")
def balanced_weights(spark, sf):
    from queuemill.operators.models import balanced_weights as weights
    from queuemill.runtime import table
    return weights(table(spark, sf, "documents"), "lang").withColumn("weight", rounded(F.col("weight")))


# ---------------------------------------------------------------- evaluation

CONF = """
SELECT g.task, a AS actual, p AS predicted, coalesce(n, 0) AS n FROM (
  SELECT l1.task, l1.c AS a, l2.c AS p FROM lb l1 JOIN lb l2 ON l1.task = l2.task) g
LEFT JOIN (SELECT task, actual, predicted, count(*) AS n FROM m0 GROUP BY ALL) k ON k.task = g.task AND actual = a AND predicted = p"""
M0 = [*PREDICTIONS, ("m0", "SELECT * FROM pd WHERE model = 'm0'"),
      ("lb", "SELECT DISTINCT task, unnest([actual, predicted]) AS c FROM m0")]


def one_model(spark, sf):
    return predictions(spark, sf).where("model = 'm0'")


@query("confusion_matrix", with_ctes(M0, CONF))
def confusion_matrix(spark, sf):
    return M.confusion_matrix(one_model(spark, sf), ["task"])


@query("confusion_normalised", with_ctes(M0, f"""
SELECT *, round(coalesce(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY task, actual), 0), 0), 4) AS share FROM ({CONF})"""))
def confusion_normalised(spark, sf):
    return M.confusion_normalised(M.confusion_matrix(one_model(spark, sf), ["task"]), ["task"])


PER_CLASS = """
SELECT task, model, class, max(role) AS role, sum(tp) AS tp, sum(support) AS support,
  coalesce(sum(tp)::DOUBLE / nullif(sum(called), 0), 0) AS precision, coalesce(sum(tp)::DOUBLE / nullif(sum(support), 0), 0) AS recall,
  coalesce(2 * sum(tp)::DOUBLE / nullif(sum(support) + sum(called), 0), 0) AS f1
FROM (SELECT task, model, role, actual AS class, (actual = predicted)::INT AS tp, 1 AS support, 0 AS called FROM pd
  UNION ALL SELECT task, model, role, predicted, 0, 0, 1 FROM pd) GROUP BY task, model, class"""
METRICS = f"""
SELECT task, model, max(role) AS role, round(sum(tp)::DOUBLE / sum(support), 4) AS accuracy, round(avg(precision), 4) AS precision_macro,
  round(avg(recall), 4) AS recall_macro, round(avg(f1), 4) AS f1_macro, round(sum(f1 * support) / sum(support), 4) AS f1_weighted
FROM ({PER_CLASS}) GROUP BY task, model"""
EVAL = [*PREDICTIONS, ("cm", f"SELECT *, CASE WHEN task = '{fixed.ROUTING}' THEN accuracy END AS correct_routing_rate FROM ({METRICS})")]


@query("per_class_report", with_ctes(PREDICTIONS, f"""
SELECT task, model, class, round(precision, 3) AS precision, round(recall, 3) AS recall, round(f1, 3) AS f1, CAST(support AS BIGINT) AS support FROM ({PER_CLASS})"""))
def per_class_report(spark, sf):
    return M.per_class_report(predictions(spark, sf), ["task", "model"])


def metric_table(spark, sf):
    return M.clf_metrics(predictions(spark, sf), ["task", "model", "role"])


@query("clf_metrics", with_ctes(EVAL, "SELECT * FROM cm"))
def clf_metrics(spark, sf):
    return metric_table(spark, sf)


@query("correct_routing_rate", with_ctes(EVAL, "SELECT task, model, correct_routing_rate FROM cm"))
def correct_routing_rate(spark, sf):
    return metric_table(spark, sf).select("task", "model", "correct_routing_rate")


@query("metrics_sort", with_ctes(EVAL, "SELECT task, model, f1_macro FROM cm ORDER BY task, f1_macro DESC, model"))
def metrics_sort(spark, sf):
    return M.metrics_sort(metric_table(spark, sf)).select("task", "model", "f1_macro")


_BEST = "SELECT * FROM cm QUALIFY row_number() OVER (PARTITION BY {} ORDER BY f1_macro DESC, model) = 1"


@query("best_row", with_ctes(EVAL, _BEST.format("task")))
def best_row(spark, sf):
    return M.best_row(metric_table(spark, sf), ["task"], "f1_macro")


@query("branch_vs_combined", with_ctes([*EVAL, ("b", _BEST.format("task, role"))], """
SELECT i.task, i.model AS branch, i.f1_macro AS branch_f1, e.model AS combined, e.f1_macro AS combined_f1, round(e.f1_macro - i.f1_macro, 4) + 0.0 AS gain
FROM b i JOIN b e ON i.task = e.task AND i.role = 'individual' AND e.role = 'ensemble'"""))
def branch_vs_combined(spark, sf):
    return M.branch_vs_combined(metric_table(spark, sf))


@query("delta_vs_previous", with_ctes(EVAL, """
SELECT task, model, f1_macro, round(f1_macro - lag(f1_macro) OVER (PARTITION BY task ORDER BY model), 4) + 0.0 AS delta FROM cm WHERE role = 'individual'"""))
def delta_vs_previous(spark, sf):
    steps = metric_table(spark, sf).where("role = 'individual'").select("task", "model", "f1_macro")
    return M.delta_vs_previous(steps, ["task"], "model", "f1_macro")


H2H = [*EVAL, ("aa", "SELECT * FROM cm WHERE role = 'ensemble' QUALIFY row_number() OVER (PARTITION BY task ORDER BY f1_macro DESC, model) = 1"),
       ("bb", "SELECT * FROM cm WHERE model = 'm2'")]


def arms(spark, sf):
    table = metric_table(spark, sf)
    return M.best_row(table.where("role = 'ensemble'"), ["task"], "f1_macro"), table.where("model = 'm2'")


_H2H = """SELECT task, metric, model_a, a, model_b, b, round(b - a, 4) + 0.0 AS delta,
  CASE WHEN round(b - a, 4) > 0 THEN 'Arm B' WHEN round(b - a, 4) < 0 THEN 'Arm A' ELSE 'tie' END AS winner FROM (
  SELECT aa.task, 'accuracy' AS metric, aa.model AS model_a, aa.accuracy AS a, bb.model AS model_b, bb.accuracy AS b FROM aa JOIN bb USING (task)
  UNION ALL SELECT aa.task, 'f1_macro', aa.model, aa.f1_macro, bb.model, bb.f1_macro FROM aa JOIN bb USING (task))"""


@query("head_to_head", with_ctes(H2H, _H2H))
def head_to_head(spark, sf):
    return M.head_to_head(*arms(spark, sf))


PAIRS = [*PREDICTIONS, ("pp", f"""SELECT a.task, ticket_id, a.actual, a.predicted AS pred_a, b.predicted AS pred_b FROM
  (SELECT * FROM pd WHERE model = 'm0') a JOIN (SELECT * FROM pd WHERE model = 'm1') b USING (task, ticket_id)""")]


def paired(spark, sf):
    every = predictions(spark, sf)
    return M.pair_predictions(every.where("model = 'm0'"), every.where("model = 'm1'"), ["task", "ticket_id"])


@query("pair_predictions", with_ctes(PAIRS, "SELECT * FROM pp"))
def pair_predictions(spark, sf):
    return paired(spark, sf)


TESTED = ("ts", """SELECT task, b, c, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1),
    lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END AS p FROM (
  SELECT task, count(*) FILTER (pred_a = actual AND pred_b <> actual) AS b, count(*) FILTER (pred_a <> actual AND pred_b = actual) AS c FROM pp GROUP BY task)""")


@query("mcnemar_exact", with_ctes([*PAIRS, TESTED], "SELECT task, b, c, round(p, 6) AS p FROM ts"))
def mcnemar_exact(spark, sf):
    return M.mcnemar(paired(spark, sf), ["task"]).withColumn("p", rounded(F.col("p")))


_SIG = """SELECT task, b, c, round(p, 5) AS p, CASE WHEN p < 0.05 THEN 'Yes' ELSE 'No' END AS significant,
  CASE WHEN p >= 0.05 THEN '—' WHEN c > b THEN 'Arm B (task-specific)' WHEN b > c THEN 'Arm A (end-to-end)' ELSE 'tie' END AS favours FROM ts"""


@query("significance_table", with_ctes([*PAIRS, TESTED], _SIG))
def significance_table(spark, sf):
    return M.significance_table(paired(spark, sf), ["task"])


@query("prefix_join", with_ctes([*H2H, PAIRS[-1], TESTED, ("sg", _SIG), ("hh", _H2H)], """
SELECT hh.task, metric, delta, sg.task || ' (paired)' AS tested_task, p, significant FROM hh JOIN sg ON starts_with(sg.task || ' (paired)', hh.task)"""))
def prefix_join(spark, sf):
    tests = M.significance_table(paired(spark, sf), ["task"]).select(
        F.concat("task", F.lit(" (paired)")).alias("tested_task"), "p", "significant")
    return M.prefix_join(M.head_to_head(*arms(spark, sf)).select("task", "metric", "delta"), tests)


_MIX = "(ticket_id * 2654435 + rep * 7919 + 42) & 4294967295"
_ROUND = "(xor(x >> 16, x) * 73244475) & 4294967295"
_POISSON = "CASE " + " ".join(f"WHEN u < {p!r}::DOUBLE THEN {k}" for k, p in enumerate(M.POISSON_STEPS)) + f" ELSE {len(M.POISSON_STEPS)} END"


@query("bootstrap_ci", with_ctes([*VOTES, ("h0", f"SELECT rep, (predicted = actual)::INT AS ok, {_MIX} AS x FROM br, (SELECT unnest(range(2000)) AS rep) WHERE model = 'm0'"),
       ("h1", f"SELECT rep, ok, {_ROUND} AS x FROM h0"), ("h2", f"SELECT rep, ok, {_ROUND} AS x FROM h1"), ("h3", f"SELECT rep, ok, {_ROUND} AS x FROM h2"),
       ("hw", f"SELECT rep, ok, {_POISSON} AS w FROM (SELECT rep, ok, xor(x >> 16, x) / 4294967296.0::DOUBLE AS u FROM h3)"),
       ("hs", "SELECT rep, sum(ok * w)::DOUBLE / sum(w) AS s FROM hw GROUP BY rep")],
       "SELECT round(quantile_cont(s, 0.025), 4) AS low, round(quantile_cont(s, 0.975), 4) AS high FROM hs"))
def bootstrap_ci(spark, sf):
    labels = branch_labels(normalised_scores(spark, sf).where("model = 'm0'"))
    return M.bootstrap_ci(labels, "ticket_id", (F.col("predicted") == F.col("actual")).cast("double"))


@query("majority_baseline", with_ctes([V.VECTORS, V.SPLIT], """
SELECT label, round(avg(CASE WHEN category = label THEN 1.0 ELSE 0.0 END), 4) AS baseline FROM sp,
  (SELECT category AS label FROM sp WHERE split = 'train' GROUP BY category ORDER BY count(*) DESC, category LIMIT 1)
WHERE split = 'test' GROUP BY label"""))
def majority_baseline(spark, sf):
    return M.majority_baseline(split(spark, sf).select(F.col("category").alias("label"), "split"))


@query("drop_pseudo_rows", with_ctes(SQ.CORPUS, f"SELECT label_type, class, n FROM ({SQ.DISTRIBUTION})"))
def drop_pseudo_rows(spark, sf):
    distribution = SC.class_distribution(SQ._prepared(spark, sf)).select("label_type", "class", F.col("n").cast("double"))
    summary = distribution.groupBy("label_type").agg(ratio(F.max("n"), F.min("n")).alias("n")).withColumn("class", F.lit("-- imbalance ratio --"))
    return M.drop_pseudo_rows(distribution.unionByName(summary)).withColumn("n", F.col("n").cast("long"))


@query("stack_fragments", with_ctes(EVAL, f"""
SELECT task, model, accuracy, f1_macro, NULL::DOUBLE AS correct_routing_rate FROM cm WHERE task = '{fixed.CLASSIFICATION}'
UNION ALL SELECT task, model, accuracy, NULL, correct_routing_rate FROM cm WHERE task = '{fixed.ROUTING}'"""))
def stack_fragments(spark, sf):
    table = metric_table(spark, sf)
    return M.stack_fragments(
        table.where(F.col("task") == fixed.CLASSIFICATION).select("task", "model", "accuracy", "f1_macro"),
        table.where(F.col("task") == fixed.ROUTING).select("task", "model", "accuracy", "correct_routing_rate"))


RUNS = [*VOTES, ("dr", """SELECT r AS repeat, ticket_id, actual, predicted, count(*) OVER (PARTITION BY r, actual) AS n,
    row_number() OVER (PARTITION BY r, actual ORDER BY md5((42 + r) || '|' || ticket_id), ticket_id) AS rk
    FROM br, (SELECT unnest(range(3)) AS r) WHERE model = 'm0'"""),
    ("kp", f"""SELECT fraction, repeat, actual, predicted FROM dr, (SELECT unnest([{', '.join(f'{f}::DOUBLE' for f in fixed.FRACTIONS)}]) AS fraction)
      WHERE rk <= greatest(1, floor(n * fraction + 0.5)) AND (fraction < 1 OR repeat = 0)"""),
    ("pc", """SELECT fraction, repeat, class, 2 * sum(tp)::DOUBLE / nullif(sum(s) + sum(p), 0) AS f1 FROM (
      SELECT fraction, repeat, actual AS class, (actual = predicted)::INT AS tp, 1 AS s, 0 AS p FROM kp
      UNION ALL SELECT fraction, repeat, predicted, 0, 0, 1 FROM kp) GROUP BY ALL"""),
    ("rn", "SELECT fraction, repeat, round(avg(f1), 12) AS f1, (SELECT count(*) FROM kp WHERE kp.fraction = pc.fraction AND kp.repeat = pc.repeat) AS n_sampled FROM pc GROUP BY fraction, repeat"),
    ("cv", "SELECT fraction, round(avg(f1), 4) AS f1_mean, round(stddev_pop(f1), 4) AS f1_sd, max(n_sampled) AS n_sampled FROM rn GROUP BY fraction")]


def _curve(spark, sf):
    labels = branch_labels(normalised_scores(spark, sf).where("model = 'm0'"))
    return M.learning_curve(M.learning_runs(labels, "ticket_id"))


@query("learning_curve", with_ctes(RUNS, "SELECT * FROM cv"))
def learning_curve(spark, sf):
    return _curve(spark, sf)


@query("marginal_value", with_ctes([*RUNS, ("mv", "SELECT " + ", ".join(
    f"max({c}) FILTER (fraction = {f}) AS {a}" for a, c, f in (("f100", "f1_mean", 1.0), ("f70", "f1_mean", 0.7), ("f20", "f1_mean", 0.2),
                                                               ("f5", "f1_mean", 0.05), ("n100", "n_sampled", 1.0), ("n70", "n_sampled", 0.7))) + " FROM cv")], """
SELECT round(f100 - f70, 4) + 0.0 AS gain_70_100, n100 - n70 AS rows_70_100, round((f100 - f70) / greatest(n100 - n70, 1) * 1000, 4) + 0.0 AS gain_per_1000,
  round(f20 - f5, 4) + 0.0 AS gain_to_20, round(f100 - f20, 4) + 0.0 AS gain_after_20 FROM mv"""))
def marginal_value(spark, sf):
    return M.marginal_value(_curve(spark, sf))


# ---------------------------------------------------------------- nearest neighbours as classifiers

KNN = [*RQ.RK[:2], ("q", "SELECT * FROM sp WHERE split = 'test'"), ("c", "SELECT * FROM sp WHERE split = 'train'"), RQ.SEM,
       ("nb", """SELECT s.*, c.category, c.team FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM sem) s
         JOIN c ON c.vec_id = candidate_id WHERE rank <= 15""")]


def neighbours(spark, sf, k=15):
    both = split(spark, sf)
    corpus = both.where("split = 'train'")
    found = R.semantic_topk(both.where("split = 'test'"), corpus, k)
    return found.join(corpus.select(F.col("vec_id").alias("candidate_id"), "category", "team"), "candidate_id")


@query("head_knn", with_ctes([*KNN, ("pr", """SELECT query_id, category AS class, sum(1 / (1 - score)) FILTER (score < 1) AS near, count(*) FILTER (score >= 1) AS exact FROM nb GROUP BY ALL""")], """
SELECT query_id, class, round(CASE WHEN sum(exact) OVER w > 0 THEN exact / sum(exact) OVER w ELSE near / sum(near) OVER w END, 6) AS score
FROM pr WINDOW w AS (PARTITION BY query_id)"""))
def head_knn(spark, sf):
    return VO.knn_scores(neighbours(spark, sf), "category").withColumn("score", rounded(F.col("score")))


def vote_sql(label, source="nb", keys="query_id"):
    return f"""SELECT {keys}, class AS predicted, round(score, 6) AS score FROM (
  SELECT {keys}, {label} AS class, sum(greatest(score, 0)) AS score, min(rank) AS met FROM {source} GROUP BY {keys}, {label})
QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY round(score, 12) DESC, met) = 1"""


@query("knn_vote", with_ctes([*KNN, ("a", vote_sql("category")), ("b", vote_sql("team"))], """
SELECT a.query_id, a.predicted AS category, a.score AS category_score, b.predicted AS team, b.score AS team_score FROM a JOIN b USING (query_id)"""))
def knn_vote(spark, sf):
    found = materialise(neighbours(spark, sf), "neighbours")
    read = lambda label: VO.knn_vote(found, label).select("query_id", F.col("predicted").alias(label), F.col("score").alias(f"{label}_score"))
    return read("category").join(read("team"), "query_id")


TUNE = [V.VECTORS, V.SPLIT, ("nb", """SELECT s.*, b.category, b.team, a.category AS true_category, a.team AS true_team, a.fold FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM (
      SELECT a.vec_id AS query_id, b.vec_id AS candidate_id, round(list_dot_product(a.embedding, b.embedding), 9) + 0.0 AS score
      FROM sp a JOIN sp b ON a.fold <> b.fold AND a.split = 'train' AND b.split = 'train')) s
    JOIN sp a ON a.vec_id = query_id JOIN sp b ON b.vec_id = candidate_id WHERE rank <= 25"""),
    ("nk", f"SELECT nb.*, k FROM nb, (SELECT unnest({list(fixed.KNN_GRID)}) AS k) WHERE rank <= k"),
    ("vt", " UNION ALL ".join(f"""SELECT k, fold, '{w}' AS what, true_{w} AS actual, class AS predicted FROM (
        SELECT k, fold, query_id, true_{w}, {w} AS class, sum(greatest(score, 0)) AS score, min(rank) AS met FROM nk GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY k, query_id ORDER BY round(score, 12) DESC, met) = 1""" for w in ("category", "team"))),
    ("pc", """SELECT k, fold, what, class, 2 * sum(tp)::DOUBLE / nullif(sum(s) + sum(p), 0) AS f1 FROM (
      SELECT k, fold, what, actual AS class, (actual = predicted)::INT AS tp, 1 AS s, 0 AS p FROM vt
      UNION ALL SELECT k, fold, what, predicted, 0, 0, 1 FROM vt) GROUP BY ALL"""),
    ("sc", "SELECT k, round(avg(f), 6) AS score FROM (SELECT k, fold, what, avg(f1) AS f FROM pc GROUP BY ALL) GROUP BY k")]


@query("tune_k", with_ctes(TUNE, "SELECT k, score, row_number() OVER (ORDER BY score DESC, k) = 1 AS selected FROM sc"))
def tune_k(spark, sf):
    from queuemill.operators.models import tune_k as tune
    train = split(spark, sf).where("split = 'train'")
    return tune(train, ["category", "team"]).withColumn("k", F.col("k").cast("long"))
