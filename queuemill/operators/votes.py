"""Algebra over class scores in long form: ticket_id, actual, model, class, class_index, score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuemill import fixed
from queuemill.functions.scalars import softmax
from queuemill.operators.features import literal_array
from queuemill.runtime import rounded

TIE_DIGITS = 12


def align_classes(scores: DataFrame, classes: list[str], keys: list[str]) -> DataFrame:
    """Every (row, model) widened to the global class order; a class the model lacks scores 0.

    The classes of one row travel as one small map, so no row is crossed with the class list.
    """
    own = scores.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("class", "score"))).alias("m"))
    wide = F.posexplode(F.transform(literal_array(classes), lambda c: F.struct(
        c.alias("class"), F.coalesce(F.element_at("m", c), F.lit(0.0)).alias("score"))))
    return own.select(*keys, wide.alias("class_index", "s")).select(
        *keys, "s.class", F.col("class_index").cast("long").alias("class_index"), "s.score")


def normalised(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of one (row, model) scaled to sum 1."""
    total = F.sum("score").over(W.partitionBy(*keys))       # as many rows as there are classes
    return scores.withColumn("score", F.col("score") / F.greatest(total, F.lit(1e-12)))


def softmax_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Margins of one (row, model) to a ranking score; marked as such."""
    entry = F.sort_array(F.collect_list(F.struct("class_index", "class", "score")))
    rows = scores.groupBy(*keys).agg(entry.alias("e"))
    powers = softmax(F.transform("e", lambda x: x["score"]))
    rows = rows.withColumn("p", powers)
    zipped = F.inline(F.arrays_zip(F.transform("e", lambda x: x["class"]).alias("class"),
                                   F.transform("e", lambda x: x["class_index"]).alias("class_index"), F.col("p").alias("score")))
    return rows.select(*keys, zipped).withColumn("score_kind", F.lit("margin"))


def argmax_class(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Top label, runner-up and confidences; equal scores go to the lowest class index.

    A row has one entry per class, so its ranking is a small array.
    """
    order = F.struct((-F.round("score", TIE_DIGITS)).alias("s"), "class_index", "class", "score")
    best = scores.groupBy(*keys).agg(F.sort_array(F.collect_list(order)).alias("r"))
    return best.select(
        *keys, F.col("r")[0]["class"].alias("predicted"), F.col("r")[0]["score"].alias("confidence"),
        F.get("r", F.lit(1))["class"].alias("runner_up"), F.get("r", F.lit(1))["score"].alias("runner_up_confidence"),
        F.transform("r", lambda x: x["class"]).alias("ranking"))


CLASS = ["class", "class_index"]


def soft_vote(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.groupBy(*keys, *CLASS).agg(F.avg("score").alias("score"))


def weighted_vote(scores: DataFrame, weights: dict[str, float], keys: list[str]) -> DataFrame:
    """Mean of branch scores by weight; weights are scaled to sum 1."""
    total = sum(weights.values())
    weight = F.create_map(*[F.lit(x) for name, w in weights.items() for x in (name, w / total)])[F.col("model")]
    return scores.groupBy(*keys, *CLASS).agg(F.sum(weight * F.col("score")).alias("score"))


def majority_vote(scores: DataFrame, keys: list[str]) -> DataFrame:
    """One vote per branch for its best class; the vote share is the score."""
    index = F.struct((-F.round("score", TIE_DIGITS)).alias("s"), "class_index", "class")
    branch = scores.groupBy(*keys, "model").agg(F.min(index).alias("b"))
    votes = branch.groupBy(*keys, F.col("b.class").alias("class"), F.col("b.class_index").alias("class_index")).agg(
        F.count(F.lit(1)).alias("n"))
    total = branch.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    return votes.join(total, keys).withColumn("score", F.col("n") / F.col("_all")).drop("n", "_all")


def vote_agreement(scores: DataFrame, combined: DataFrame, keys: list[str]) -> DataFrame:
    """Adds to the combined labels the share of branches that agree with them."""
    index = F.struct((-F.round("score", TIE_DIGITS)).alias("s"), "class_index", "class")
    branch = scores.groupBy(*keys, "model").agg(F.min(index)["class"].alias("branch_label"))
    together = branch.join(combined.select(*keys, "predicted"), keys)
    share = together.groupBy(*keys).agg(F.avg((F.col("branch_label") == F.col("predicted")).cast("double")).alias("agreement"))
    return combined.join(share, keys)


def abstain_route(labelled: DataFrame, threshold: float = fixed.ABSTAIN_BELOW, first_line: str = fixed.FIRST_LINE) -> DataFrame:
    """A weak confidence is declined and filed to the first line; the guess is kept."""
    weak = F.col("confidence") < threshold
    return labelled.withColumns({"abstain": weak, "proposed": F.col("predicted"),
                                 "team": F.when(weak, F.lit(first_line)).otherwise(F.col("predicted"))})


def abstain_on_disagreement(voted: DataFrame, threshold: float = fixed.AGREEMENT_BELOW) -> DataFrame:
    """Too little agreement is declined; the label stays and nothing is re-filed."""
    return voted.withColumn("abstain", F.col("agreement") < threshold)


def score_block(scores: DataFrame, key: str) -> DataFrame:
    """Class scores of one model as an array in class order: a feature block per ticket."""
    entry = F.sort_array(F.collect_list(F.struct("class_index", "score")))
    return scores.groupBy(key).agg(entry.alias("_e")).select(key, F.transform("_e", lambda x: x["score"]).alias("cat"))


def cascade_join(tickets: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    return tickets.join(score_block(scores, key), key)


def knn_scores(neighbours: DataFrame, label: str = "label", keys: tuple = ("query_id",)) -> DataFrame:
    """Votes by inverse distance; exact matches, where there are any, take the whole vote."""
    exact = F.col("score") >= 1.0
    per = neighbours.groupBy(*keys, F.col(label).alias("class")).agg(
        F.sum(F.when(~exact, 1.0 / (1.0 - F.col("score")))).alias("near"), F.count_if(exact).alias("exact"))
    totals = per.groupBy(*keys).agg(F.sum("near").alias("all_near"), F.sum("exact").alias("all_exact"))
    share = F.when(F.col("all_exact") > 0, F.col("exact") / F.col("all_exact")).otherwise(F.try_divide("near", "all_near"))
    return per.join(totals, list(keys)).select(*keys, "class", F.coalesce(share, F.lit(0.0)).alias("score"))


def knn_vote(neighbours: DataFrame, label: str, keys: tuple = ("query_id",)) -> DataFrame:
    """Votes by similarity, negatives clipped; a tie goes to the label met first."""
    votes = neighbours.groupBy(*keys, F.col(label).alias("class")).agg(
        F.sum(F.greatest("score", F.lit(0.0))).alias("score"), F.min("rank").alias("met"))
    order = F.struct((-F.round("score", TIE_DIGITS)).alias("s"), "met", "class", "score")
    best = votes.groupBy(*keys).agg(F.min(order).alias("b"))
    return best.select(*keys, F.col("b.class").alias("predicted"), rounded(F.col("b.score")).alias("score"))
