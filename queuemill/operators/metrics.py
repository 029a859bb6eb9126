"""Evaluation: everything starts from (actual, predicted) counts, reduced before any shuffle.

Predictions: ticket_id, actual, predicted and grouping columns such as task and model.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from queuemill import fixed
from queuemill.operators.ranking import hash_segment, segmented_rank
from queuemill.operators.sampling import digest
from queuemill.runtime import ratio, rounded


def pair_counts(predictions: DataFrame, by: list[str]) -> DataFrame:
    return predictions.groupBy(*by, "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Counts over the full class grid, absent pairs 0: a grid of zeros and the counts, summed."""
    counted = pair_counts(predictions, by)
    labels = counted.groupBy(*by).agg(F.array_union(F.collect_set("actual"), F.collect_set("predicted")).alias("labels"))
    grid = labels.withColumn("actual", F.explode("labels")).withColumn("predicted", F.explode("labels"))
    zeros = grid.select(*by, "actual", "predicted", F.lit(0).cast("long").alias("n"))
    return counted.unionByName(zeros).groupBy(*by, "actual", "predicted").agg(F.sum("n").alias("n"))


def confusion_normalised(confusion: DataFrame, by: list[str]) -> DataFrame:
    row = F.sum("n").over(W.partitionBy(*by, "actual"))
    share = F.coalesce(ratio(F.col("n"), row), F.lit(0.0))
    return confusion.withColumn("share", rounded(share, 4))


def per_class(predictions: DataFrame, by: list[str]) -> DataFrame:
    """precision, recall, f1 and support per class; 0 where a denominator is 0."""
    zero = F.lit(0).cast("long")
    sides = F.explode(F.array(
        F.struct(F.col("actual").alias("class"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(zero).alias("tp"),
                 F.col("n").alias("support"), zero.alias("called")),
        F.struct(F.col("predicted").alias("class"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("called"))))
    cells = pair_counts(predictions, by).select(*by, sides.alias("s")).select(*by, "s.*")
    sums = cells.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "called")])
    or_zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    return sums.select(
        *by, "class", "support", "tp",
        or_zero(F.col("tp"), F.col("called")).alias("precision"), or_zero(F.col("tp"), F.col("support")).alias("recall"),
        or_zero(2 * F.col("tp"), F.col("support") + F.col("called")).alias("f1"))


def per_class_report(predictions: DataFrame, by: list[str]) -> DataFrame:
    report = per_class(predictions, by).select(*by, "class", *[rounded(F.col(c), 3).alias(c) for c in ("precision", "recall", "f1")], "support")
    return report.orderBy(*by, F.desc("support"), "class")


def clf_metrics(predictions: DataFrame, by: list[str], digits: int = 4) -> DataFrame:
    """accuracy, macro precision/recall/F1 and weighted F1; the routing rate only for routing."""
    total = F.sum("support")
    table = per_class(predictions, by).groupBy(*by).agg(
        rounded(F.sum("tp") / total, digits).alias("accuracy"),
        *[rounded(F.avg(c), digits).alias(f"{c}_macro") for c in ("precision", "recall", "f1")],
        rounded(F.sum(F.col("f1") * F.col("support")) / total, digits).alias("f1_weighted"))
    if "task" in by:
        table = table.withColumn("correct_routing_rate", F.when(F.col("task") == fixed.ROUTING, F.col("accuracy")))
    return table


def metrics_sort(table: DataFrame) -> DataFrame:
    return table.orderBy("task", F.desc("f1_macro"), "model")


def best_row(table: DataFrame, by: list[str], metric: str, name: str = "model") -> DataFrame:
    """The whole row with the highest metric per group; equal metrics keep the first name."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(metric), name))
    return table.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def majority_baseline(labelled: DataFrame) -> DataFrame:
    """The most common training label (smallest on ties) and its share of the test rows.

    Input: label, split. One pass counts both splits; the rest works on one row per label.
    """
    counts = labelled.groupBy("label").agg(
        F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))
    top = counts.agg(F.min_by("label", F.struct(-F.col("train"), F.col("label"))).alias("label"),
                     F.min_by("test", F.struct(-F.col("train"), F.col("label"))).alias("hits"), F.sum("test").alias("n"))
    return top.select("label", rounded(ratio(F.col("hits"), F.col("n")), 4).alias("baseline"))


# ---------------------------------------------------------------- paired tests

def pair_predictions(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two models' predictions of the same rows, joined on the key and not on position."""
    a = left.select(*keys, "actual", F.col("predicted").alias("pred_a"))
    return a.join(right.select(*keys, F.col("predicted").alias("pred_b")), keys)


@F.pandas_udf(DoubleType())
def binomial_two_sided(b: pd.Series, c: pd.Series) -> pd.Series:
    """Exact two-sided p at 1/2: twice the lower tail, summed from its largest term outwards."""
    def p(b, c):
        n, m = int(b + c), int(min(b, c))
        if n == 0 or 2 * m == n:
            return 1.0
        term = math.exp(math.lgamma(n + 1) - math.lgamma(m + 1) - math.lgamma(n - m + 1) - n * math.log(2))
        total, i = 0.0, m
        while i >= 0 and term > total * 1e-17:
            total += term
            term *= i / (n - i + 1)
            i -= 1
        return min(1.0, 2 * total)
    return pd.Series([p(x, y) for x, y in zip(b, c)], dtype="float64")


def mcnemar(pairs: DataFrame, by: list[str]) -> DataFrame:
    """b: A right and B wrong; c: A wrong and B right; exact p."""
    right_a, right_b = F.col("pred_a") == F.col("actual"), F.col("pred_b") == F.col("actual")
    counts = pairs.groupBy(*by).agg(F.count_if(right_a & ~right_b).alias("b"), F.count_if(~right_a & right_b).alias("c"))
    return counts.withColumn("p", binomial_two_sided("b", "c"))


def significance_table(pairs: DataFrame, by: list[str], arms=("Arm A (end-to-end)", "Arm B (task-specific)")) -> DataFrame:
    tested = mcnemar(pairs, by)
    favours = (F.when(F.col("p") >= 0.05, "—").when(F.col("c") > F.col("b"), arms[1])
               .when(F.col("b") > F.col("c"), arms[0]).otherwise("tie"))
    return tested.select(*by, "b", "c", rounded(F.col("p"), 5).alias("p"),
                         F.when(F.col("p") < 0.05, "Yes").otherwise("No").alias("significant"), favours.alias("favours"))


# ---------------------------------------------------------------- bootstrap

MASK = 0xFFFFFFFF
POISSON_STEPS = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]


def mixed(row_id: Column, replicate: Column, seed: int) -> Column:
    """A 32-bit hash of (row, replicate) from shifts, xors and products that fit a long."""
    x = (row_id * 2654435 + replicate * 7919 + seed).bitwiseAND(F.lit(MASK))
    for _ in range(3):
        x = (F.shiftright(x, 16).bitwiseXOR(x) * 73244475).bitwiseAND(F.lit(MASK))
    return F.shiftright(x, 16).bitwiseXOR(x)


def poisson_weight(u: Column) -> Column:
    weight = F.lit(len(POISSON_STEPS))
    for k in reversed(range(len(POISSON_STEPS))):
        weight = F.when(u < POISSON_STEPS[k], k).otherwise(weight)
    return weight


def bootstrap_ci(rows: DataFrame, row_id: str, value: Column, n_boot: int = fixed.BOOTSTRAPS, alpha: float = 0.05,
                 seed: int = fixed.SEED) -> DataFrame:
    """Percentile interval of the mean of `value`.

    Each row draws a Poisson(1) weight per replicate from a hash, so replicates need no data movement: rows are multiplied inside
    their task and summed per replicate before the shuffle. NULL values don't count.
    """
    drawn = rows.select(F.col(row_id).cast("long").alias("_id"), value.alias("_v")).where(F.col("_v").isNotNull()).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("replicate"))
    u = mixed(F.col("_id"), F.col("replicate").cast("long"), seed) / F.lit(float(MASK + 1))
    weight = F.col("_w")
    stats = drawn.withColumn("_w", poisson_weight(u)).groupBy("replicate").agg(
        F.try_divide(F.sum(F.col("_v") * weight), F.sum(weight).cast("double")).alias("s"))
    ends = stats.agg(F.percentile("s", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    return ends.select(rounded(F.col("q")[0], 4).alias("low"), rounded(F.col("q")[1], 4).alias("high"))


# ---------------------------------------------------------------- thresholds and agreement

def abstention_curve(predictions: DataFrame, first_line: str, grid=fixed.ABSTAIN_GRID) -> DataFrame:
    """Per threshold: coverage, accuracy answered and declined, first-line share and enrichment.

    One pass with a few conditional counts per threshold; rows are not multiplied.
    """
    ok, line = F.col("predicted") == F.col("actual"), F.col("actual") == first_line
    counts = [F.count(F.lit(1)).alias("n"), F.count_if(line).alias("line")]
    for i, t in enumerate(grid):
        answered = F.col("confidence") >= t
        counts += [F.count_if(answered).alias(f"a{i}"), F.count_if(answered & ok).alias(f"ok{i}"),
                   F.count_if(~answered & ok).alias(f"no{i}"), F.count_if(~answered & line).alias(f"l{i}")]
    one, rows = predictions.agg(*counts), []
    for i, t in enumerate(grid):
        declined = F.col("n") - F.col(f"a{i}")
        share = ratio(F.col(f"l{i}"), declined)
        rows.append(F.struct(
            F.lit(float(t)).alias("threshold"), rounded(100 * ratio(F.col(f"a{i}"), F.col("n")), 1).alias("answered_pct"),
            rounded(ratio(F.col(f"ok{i}"), F.col(f"a{i}")), 4).alias("accuracy_answered"),
            rounded(ratio(F.col(f"no{i}"), declined), 4).alias("accuracy_declined"),
            rounded(100 * share, 1).alias("first_line_pct"),
            rounded(F.try_divide(share, ratio(F.col("line"), F.col("n"))), 2).alias("enrichment")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def agreement_accuracy(voted: DataFrame, threshold: float = fixed.AGREEMENT_BELOW) -> DataFrame:
    """Accuracy by share of agreeing branches, beside coverage and accuracy at the threshold."""
    ok = F.col("predicted") == F.col("actual")
    levels = voted.groupBy(rounded(F.col("agreement"), 2).alias("agreement")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("ok"))
    every, above = W.partitionBy(), F.col("agreement") >= threshold   # one row per agreement level
    kept = F.sum(F.when(above, F.col("n")).otherwise(0)).over(every)
    right = F.sum(F.when(above, F.col("ok")).otherwise(0)).over(every)
    return levels.select("agreement", "n", rounded(ratio(F.col("ok"), F.col("n")), 4).alias("accuracy"),
                         rounded(ratio(kept, F.sum("n").over(every)), 4).alias("coverage_at_threshold"),
                         rounded(ratio(right, kept), 4).alias("accuracy_at_threshold"))


# ---------------------------------------------------------------- comparison tables (a few rows each)

def head_to_head(arm_a: DataFrame, arm_b: DataFrame, metrics=("accuracy", "f1_macro")) -> DataFrame:
    """Long form: task, metric, both arms and the difference."""
    long = lambda df, side: df.select("task", F.col("model").alias(f"model_{side}"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("r")).select(
        "task", f"model_{side}", "r.metric", F.col("r.value").alias(side))
    both = long(arm_a, "a").join(long(arm_b, "b"), ["task", "metric"])
    delta = rounded(F.col("b") - F.col("a"), 4)
    winner = F.when(delta > 0, "Arm B").when(delta < 0, "Arm A").otherwise("tie")
    return both.withColumns({"delta": delta, "winner": winner})


def branch_vs_combined(table: DataFrame) -> DataFrame:
    """Best single branch against best combined model, per task; input has `role`."""
    best = best_row(table, ["task", "role"], "f1_macro")
    pick = lambda role, column: F.max(F.when(F.col("role") == role, F.col(column)))
    merged = best.groupBy("task").agg(
        pick("individual", "model").alias("branch"), pick("individual", "f1_macro").alias("branch_f1"),
        pick("ensemble", "model").alias("combined"), pick("ensemble", "f1_macro").alias("combined_f1"))
    return merged.withColumn("gain", rounded(F.col("combined_f1") - F.col("branch_f1"), 4))


def delta_vs_previous(table: DataFrame, by: list[str], step: str, score: str) -> DataFrame:
    before = F.lag(score).over(W.partitionBy(*by).orderBy(step))
    return table.withColumn("delta", rounded(F.col(score) - before, 4))


def prefix_join(results: DataFrame, tests: DataFrame) -> DataFrame:
    """A result row meets the test row whose task name starts with its own (report-sized tables).

    A prefix is not an equality, so each test row offers every prefix of its name as a key.
    """
    name = F.col("tested_task")
    offered = tests.withColumn("_prefix", F.explode(F.transform(
        F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, F.lit(1), i))))
    return results.join(offered, F.col("task") == F.col("_prefix")).drop("_prefix")


def drop_pseudo_rows(table: DataFrame, column: str = "class") -> DataFrame:
    return table.where(~F.col(column).startswith("--"))


def stack_fragments(*fragments: DataFrame) -> DataFrame:
    stacked = fragments[0]
    for other in fragments[1:]:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    return stacked


def learning_runs(predictions: DataFrame, row_id: str, fractions=fixed.FRACTIONS, repeats: int = fixed.REPEATS,
                  seed: int = fixed.SEED) -> DataFrame:
    """Macro F1 on every stratified sample (fraction, repeat); the full set is scored once."""
    repeat = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")
    drawn = predictions.select("*", repeat)
    digests = F.array(*[digest(seed + r, row_id) for r in range(repeats)])
    drawn = drawn.withColumn("_digest", digests[F.col("repeat")])
    placed = segmented_rank(drawn, ["repeat", "actual"], hash_segment(F.col("_digest")), ["_digest", row_id], total="_n")
    tagged = placed.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fractions])))
    quota = F.greatest(F.lit(1), F.floor(F.col("_n") * F.col("fraction") + 0.5))
    kept = tagged.where((F.col("rk") <= quota) & ((F.col("fraction") < 1.0) | (F.col("repeat") == 0)))
    sizes = kept.groupBy("fraction", "repeat").agg(F.count(F.lit(1)).alias("n_sampled"))
    return clf_metrics(kept, ["fraction", "repeat"], 12).select("fraction", "repeat", F.col("f1_macro").alias("f1")).join(
        sizes, ["fraction", "repeat"])


def learning_curve(runs: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean and population deviation of macro F1 per fraction, and the sampled count."""
    return runs.groupBy(*by, "fraction").agg(
        rounded(F.avg("f1"), 4).alias("f1_mean"), rounded(F.stddev_pop("f1"), 4).alias("f1_sd"),
        F.max("n_sampled").alias("n_sampled"))


def marginal_value(curve: DataFrame, by: list[str] = ()) -> DataFrame:
    """What the last 30 % of the data bring, in all and per 1,000 rows, and the gain up to 20 %."""
    at = lambda f, c="f1_mean": F.max(F.when(F.abs(F.col("fraction") - f) < 1e-9, F.col(c)))
    rows = at(1.0, "n_sampled") - at(0.7, "n_sampled")
    gain = at(1.0) - at(0.7)
    return curve.groupBy(*by).agg(
        rounded(gain, 4).alias("gain_70_100"), rows.alias("rows_70_100"),
        rounded(gain / F.greatest(rows, F.lit(1)) * 1000, 4).alias("gain_per_1000"),
        rounded(at(0.2) - at(0.05), 4).alias("gain_to_20"), rounded(at(1.0) - at(0.2), 4).alias("gain_after_20"))
