"""Screening, preparation and profiling of the ticket corpus.

Columns: ord, ticket_id, subject, description, category, team, department, created, resolution ...
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuemill import fixed
from queuemill.functions import text as X
from queuemill.runtime import ratio, rounded

DUPLICATE_KEY = ["subject", "description", "category", "created"]


def join_truth(tickets: DataFrame, truth: DataFrame) -> DataFrame:
    return tickets.join(truth, "ticket_id", "left")


def drop_test_tickets(tickets: DataFrame) -> DataFrame:
    return tickets.where(~X.is_test_ticket(F.col("subject"), F.col("description")))


def drop_no_text(tickets: DataFrame) -> DataFrame:
    return tickets.where(~X.lacks_text(F.col("subject"), F.col("description")))


def drop_blank(tickets: DataFrame, column: str) -> DataFrame:
    return tickets.where(F.trim(F.coalesce(column, F.lit(""))) != "")


def first_occurrence(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The earliest row of every key.

    An aggregate instead of a window: copies collapse before the shuffle, however many there are.
    """
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def drop_exact_duplicates(tickets: DataFrame) -> DataFrame:
    return first_occurrence(tickets, DUPLICATE_KEY)


def screen(tickets: DataFrame) -> DataFrame:
    """The five screening steps, in order."""
    kept = drop_no_text(drop_exact_duplicates(drop_test_tickets(tickets.na.fill(""))))
    return drop_blank(drop_blank(kept, "category"), "team")


def screening_audit(tickets: DataFrame) -> DataFrame:
    """Per step: removed, remaining and retention.

    Every step but the last depends on the duplicate key alone and the last one on the first row
    of the key, so one aggregate over the keys carries the whole waterfall.
    """
    groups = tickets.na.fill("").groupBy(*DUPLICATE_KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("team", "ord").alias("team"))
    blank = lambda c: F.trim(c) == ""
    fate = (F.when(X.is_test_ticket(F.col("subject"), F.col("description")), 1)
            .when(X.lacks_text(F.col("subject"), F.col("description")), 3)
            .when(blank("category"), 4).when(blank("team"), 5).otherwise(6))
    tagged = groups.select("n", fate.alias("fate"))
    one = lambda step: F.count_if(F.col("fate") == step)
    totals = tagged.agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(F.col("fate") == 1, F.col("n"))), F.lit(0)).alias("r1"),
        F.coalesce(F.sum(F.when(F.col("fate") != 1, F.col("n") - 1)), F.lit(0)).alias("r2"),
        one(3).alias("r3"), one(4).alias("r4"), one(5).alias("r5"))
    removed = [F.lit(0).cast("long"), *[F.col(f"r{i}") for i in range(1, 6)]]
    rows, left = [], F.col("total")
    for number, (name, gone) in enumerate(zip(fixed.SCREENING_STEPS, removed)):
        left = left - gone
        rows.append(F.struct(F.lit(number).cast("long").alias("step_no"), F.lit(name).alias("step"),
                             gone.alias("removed"), left.alias("remaining"),
                             rounded(100 * ratio(left, F.col("total")), 1).alias("retention")))
    return totals.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def prepare(tickets: DataFrame) -> DataFrame:
    """Screened tickets with the cleaned views; texts under three tokens are dropped here."""
    cleaned = computed_once(screen(tickets), {
        "subject_clean": X.clean_text(F.col("subject")),
        "desc_clean": X.clean_text(F.col("description")),
        "res_clean": F.coalesce("resolution", F.lit(""))})
    built = cleaned.withColumn("text", X.weighted_text(F.col("subject_clean"), F.col("desc_clean")))
    return min_tokens(built)


def computed_once(df: DataFrame, columns: dict) -> DataFrame:
    """Adds costly columns behind a generator, so a later filter on them is not pushed below and
    the columns are not evaluated a second time for it."""
    made = F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))
    return df.select("*", F.inline(made))


def min_tokens(prepared: DataFrame) -> DataFrame:
    return prepared.where(X.token_count(F.col("text")) >= fixed.MIN_TOKENS)


def resolved_corpus(prepared: DataFrame) -> DataFrame:
    return drop_blank(prepared, "resolution")


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """label → code in alphabetical order; one row per distinct label."""
    distinct = df.select(F.col(label).alias("label")).distinct()
    return distinct.withColumn("code", F.dense_rank().over(W.orderBy("label")).cast("long") - 1)


def class_list(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    both = train.select(F.col(label).alias("label")).union(test.select(F.col(label).alias("label")))
    return both.distinct().orderBy("label")


def class_distribution(prepared: DataFrame) -> DataFrame:
    """n and share per class, for categories and teams, in one pass."""
    labels = F.explode(F.array(
        F.struct(F.lit("Category").alias("label_type"), F.col("category").alias("class")),
        F.struct(F.lit("Resolver team").alias("label_type"), F.col("team").alias("class")))).alias("l")
    counted = prepared.select(labels).groupBy("l.label_type", "l.class").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("label_type"))
    return counted.withColumn("pct", percent_of(F.col("n"), total))


def percent_of(part, total):
    return rounded(100 * ratio(part, total), 1)


def imbalance_ratio(distribution: DataFrame) -> DataFrame:
    return distribution.groupBy("label_type").agg(
        rounded(ratio(F.max("n"), F.min("n")), 2).alias("imbalance"))


def corpus_profile(prepared: DataFrame) -> DataFrame:
    tokens = X.token_count(F.col("text"))
    names = lambda column: F.sort_array(F.collect_set(column))
    return prepared.agg(
        F.count(F.lit(1)).alias("n_clean"),
        names("category").alias("categories"), names("team").alias("teams"),
        rounded(F.avg(tokens), 1).alias("mean_tokens"),
        F.floor(F.percentile(tokens, F.lit(0.5))).cast("long").alias("median_tokens"))
