"""Seeded, stratified splits, folds and samples.

The order inside a class is the digest of (seed, id). Ranks come from digest segments, so a class
that holds most rows is ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuemill import fixed
from queuemill.operators.ranking import hash_segment, segmented_rank


def digest(seed, row_id: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string")).cast("binary"))


def _ranked(df: DataFrame, label: str, row_id: str, seed) -> DataFrame:
    hashed = df.withColumn("_digest", digest(seed, row_id))
    ranked = segmented_rank(hashed, [label], hash_segment(F.col("_digest")), ["_digest", row_id], total="n_class")
    return ranked.drop("_digest")


def stratified_split(df: DataFrame, label: str, row_id: str, seed=fixed.SEED, share=fixed.TEST_SHARE,
                     folds: int = fixed.FOLDS) -> DataFrame:
    """Adds `split` and `fold`: a fixed share of every class is held out."""
    ranked = _ranked(df, label, row_id, seed)
    quota = F.floor(F.lit(share) * F.col("n_class") + 0.5)
    return (ranked.withColumn("split", F.when(F.col("rk") <= quota, "test").otherwise("train"))
            .withColumn("fold", (F.col("rk") - 1) % folds).drop("rk", "n_class"))


def stratified_folds(df: DataFrame, label: str, row_id: str, seed=fixed.SEED, folds: int = fixed.FOLDS) -> DataFrame:
    ranked = _ranked(df, label, row_id, seed)
    return ranked.withColumn("fold", (F.col("rk") - 1) % folds).drop("rk", "n_class")


def stratified_sample(df: DataFrame, label: str, row_id: str, fraction: float, repeat: int = 0,
                      seed: int = fixed.SEED) -> DataFrame:
    """max(1, round(n * fraction)) rows of every class."""
    ranked = _ranked(df, label, row_id, seed + repeat)
    quota = F.greatest(F.lit(1), F.floor(F.col("n_class") * F.lit(fraction) + 0.5))
    return ranked.where(F.col("rk") <= quota).drop("rk", "n_class")
