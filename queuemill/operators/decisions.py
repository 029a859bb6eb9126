"""The decision log: validation, summaries, and labelled examples drawn from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuemill import fixed
from queuemill.functions import scalars as S
from queuemill.functions import text as X
from queuemill.operators.ranking import null_safe_join
from queuemill.runtime import blank_to_null, present, ratio, rounded

FLAGS = ("abstained", "rejected", "enriched")
EXAMPLE_KEY = ["at", "subject", "category", "assigned_team"]


def validated(entries: DataFrame) -> DataFrame:
    """Bounded texts, plain booleans and the two derived override flags."""
    cut = {name: S.truncated(F.col(name), limit) for name, limit in fixed.DECISION_LIMITS.items()}
    flags = {name: F.coalesce(F.col(name), F.lit(False)) for name in FLAGS}
    over = {f"{what}_overridden": S.overridden(F.col(f"suggested_{what}"), F.col(f"chosen_{what}"))
            for what in ("category", "team")}
    return entries.withColumns({**cut, **flags, **over})


def summary(decisions: DataFrame) -> DataFrame:
    """Every headline count and rate in one pass."""
    has = lambda name: present(F.col(name))
    lift = F.when(F.col("enriched"), F.col("confidence_after") - F.col("confidence_before"))
    chose_category, chose_team = has("chosen_category"), has("chosen_team")
    counts = decisions.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(chose_category).alias("category_decided"),
        F.count_if(chose_category & F.col("category_overridden")).alias("category_overridden"),
        F.count_if(chose_team).alias("team_decided"),
        F.count_if(chose_team & F.col("team_overridden")).alias("team_overridden"),
        F.count_if(has("resolution_used")).alias("resolutions_reused"),
        F.count_if(has("resolved_with")).alias("resolved_from_past"),
        F.count_if(has("referred_to")).alias("referred"),
        F.count_if(has("closed_as_duplicate_of")).alias("closed_as_duplicate"),
        F.count_if("abstained").alias("abstained"),
        F.count_if("rejected").alias("rejected"),
        F.count_if(lift.isNotNull()).alias("enriched"),
        F.avg(lift).alias("_lift"))
    return counts.select(
        "*",
        rounded(1 - ratio(F.col("category_overridden"), F.col("category_decided")), 3).alias("category_accept_rate"),
        rounded(1 - ratio(F.col("team_overridden"), F.col("team_decided")), 3).alias("team_accept_rate"),
        rounded(ratio(F.col("referred"), F.col("team_decided")), 3).alias("referral_rate"),
        rounded(F.col("_lift"), 3).alias("mean_confidence_lift")).drop("_lift")


def override_flows(decisions: DataFrame, limit: int = 5) -> DataFrame:
    """Where overrides go: the most common (suggested, chosen) pairs."""
    over = decisions.where(present(F.col("chosen_team")) & F.col("team_overridden"))
    return (over.groupBy(F.col("suggested_team").alias("from_team"), F.col("chosen_team").alias("to_team"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "from_team", "to_team").limit(limit))


def last_n(decisions: DataFrame, n: int, order: str = "decision_id") -> DataFrame:
    """The newest records first: a bounded top-n, never a full sort."""
    return decisions.orderBy(F.desc(order)).limit(n)


def enrichment_examples(decisions: DataFrame, n: int = 3) -> DataFrame:
    both = decisions.where(F.col("enriched") & F.col("confidence_before").isNotNull()
                           & F.col("confidence_after").isNotNull())
    cut = lambda name: F.substring(name, 1, fixed.EXAMPLE_TEXT)
    return last_n(both, n).select("decision_id", cut("text_before").alias("before"), cut("text_after").alias("after"),
                                  F.col("confidence_before").alias("from"), F.col("confidence_after").alias("to"))


def to_examples(decisions: DataFrame) -> DataFrame:
    """Labelled examples; a rejection that names nothing carries no label."""
    plain = F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))
    return (decisions
            .withColumn("provenance", S.provenance())
            .withColumn("text", F.trim(F.coalesce(blank_to_null(F.col("text_after")), plain)))
            .where(F.col("provenance").isNotNull() & (X.token_count(F.col("text")) >= fixed.MIN_TOKENS))
            .select("at", "arm", "subject", "description",
                    F.coalesce("chosen_category", F.lit("")).alias("category"),
                    F.coalesce("chosen_team", F.lit("")).alias("assigned_team"),
                    "provenance", (F.col("rejected") & ~present(F.col("chosen_team"))).alias("rejected_only"),
                    "confidence_before", "confidence_after", "text"))


def promote_new(examples: DataFrame, held: DataFrame) -> DataFrame:
    """Examples not yet held; repeats inside one batch all stay.

    The stored keys are made distinct before they are shuffled, so copies of one key cost one row.
    """
    return null_safe_join(examples, held.select(*EXAMPLE_KEY).distinct(), EXAMPLE_KEY, "left_anti")


def trainable(held: DataFrame, policy: tuple[str, ...] = fixed.TRAIN_POLICY) -> DataFrame:
    return held.where(F.col("provenance").isin(*policy) & present(F.col("category"))
                      & present(F.col("assigned_team")) & ~F.col("rejected_only"))


def feedback_summary(held: DataFrame, policy: tuple[str, ...] = fixed.TRAIN_POLICY) -> DataFrame:
    usable = (F.col("provenance").isin(*policy) & present(F.col("category"))
              & present(F.col("assigned_team")) & ~F.col("rejected_only"))
    kinds = (fixed.CORRECTED, fixed.ENRICHED, fixed.CONFIRMED)
    return held.agg(
        F.count(F.lit(1)).alias("held"),
        *[F.count_if(F.col("provenance") == kind).alias(kind) for kind in kinds],
        F.count_if(usable).alias("trainable"),
        F.count_if("rejected_only").alias("rejections_without_a_label"),
        rounded(F.avg(F.col("confidence_after") - F.col("confidence_before")), 3).alias("mean_enrichment_lift"))
