"""Exact ranks and carried values that stay parallel when one key holds most of the rows.

A plain window sends every row of a key to one task. Here the order is cut into segments first:
rows are ranked inside (key, segment), and only one summary row per segment is ordered per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEGMENT_ROWS = 1 << 20


def ordinal_segment(order: Column, rows: int = SEGMENT_ROWS) -> Column:
    """Consecutive ids, `rows` at a time."""
    return F.floor(order / F.lit(rows)).cast("long")


def order_segment(df: DataFrame, order: str, rows: int = SEGMENT_ROWS) -> Column:
    """Segments of about `rows` rows along a numeric order, also where ids lie far apart.

    Dense ids are cut by their value. Ids with gaps would give a segment for nearly each row; they are cut at
    quantiles, one number per segment.
    """
    ends = df.agg(F.count(order).alias("n"), F.min(order).alias("low"), F.max(order).alias("high")).first()
    wanted = -(-ends.n // rows)
    if not ends.n or (ends.high - ends.low) // rows <= 4 * wanted:
        return ordinal_segment(F.col(order), rows)
    cuts = df.agg(F.percentile_approx(order, [k / wanted for k in range(1, wanted)] or [0.5], 100 * wanted).alias("q")).first().q
    bounds = F.array(*[F.lit(int(c)).cast("long") for c in sorted(set(cuts))])
    return F.size(F.filter(bounds, lambda b: b <= F.col(order))).cast("long")


def hash_segment(digest: Column, hex_digits: int = 4) -> Column:
    """The leading digits of a digest: evenly filled segments in digest order."""
    return F.substring(digest, 1, hex_digits)


def segmented_rank(df: DataFrame, keys: list[str], segment: Column, order: list[str],
                   rank: str = "rk", total: str | None = None) -> DataFrame:
    """row_number over (keys, order), exact; `segment` must not decrease along the order.

    With `total`, the number of rows of the key is added as well.
    """
    df = df.withColumn("_segment", segment)
    part = [*keys, "_segment"]
    sizes = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_size"))
    along = W.partitionBy(*keys).orderBy("_segment")
    before = sizes.select(
        *part,
        (F.sum("_size").over(along) - F.col("_size")).alias("_before"),
        *([F.sum("_size").over(W.partitionBy(*keys)).alias(total)] if total else []))
    inner = F.row_number().over(W.partitionBy(*part).orderBy(*order))
    out = null_safe_join(df.withColumn("_inner", inner), before, part)
    return out.withColumn(rank, F.col("_inner") + F.col("_before")).drop("_segment", "_inner", "_before")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match; the right keys are dropped."""
    right = right.withColumnsRenamed({key: f"_r_{key}" for key in keys})
    match = [F.col(key).eqNullSafe(F.col(f"_r_{key}")) for key in keys]
    joined = left.join(right, match, how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*[f"_r_{key}" for key in keys])


def previous_value(df: DataFrame, key: str, order: str, value: Column, out: str,
                   segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The last non-null `value` strictly before each row of the same key."""
    df = df.withColumn("_value", value).withColumn("_segment", order_segment(df, order, segment_rows))
    part = [key, "_segment"]
    # One summary row per segment, also where the segment sets no value.
    ends = df.groupBy(*part).agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_end"))
    earlier = W.partitionBy(key).orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*part, F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    local = F.last("_value", ignorenulls=True).over(
        W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return (df.withColumn("_local", local).join(carried, part, "left")
            .withColumn(out, F.coalesce("_local", "_carried"))
            .drop("_value", "_segment", "_local", "_carried"))
