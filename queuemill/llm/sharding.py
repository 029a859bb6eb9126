"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards. Every shard draws an exponential number -ln(u)/weight for a row, u being a
hash of the row's key and the shard's name; a rack's draw is the least draw of its shards, a region's the least of its
racks. The least of exponential draws is again exponential, with the sum of the weights as its rate, so every level
is a weighted draw by the weight below it. A row descends from region to rack to shard, each time to the least draw.

As a subtree's draw is made of its own shards' draws alone, nothing moves between two subtrees whose weights stay: more
weight on a shard takes rows only into that shard, less weight only out of it. (Drawing once per inner node by its
total weight would not do: a heavier region would also pull rows into its old shards.)

Null keys hash like any other value and meet in one shard. A shard of weight 0 gets nothing. Repeated rows share their
shard and have slots of their own. An empty table gives an empty table. Extra columns are left out of the results.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuemill.runtime import materialise


class Shard(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


RACKS_PER_REGION = 4
SHARDS_PER_RACK = 4


def even_tree(shards: int) -> list[Shard]:
    """Shards 0, 1, ... fill racks, racks fill regions; one more shard never renames another."""
    per_region = RACKS_PER_REGION * SHARDS_PER_RACK
    return [Shard(n // per_region, n // SHARDS_PER_RACK, n) for n in range(shards)]


def draw(key: Column, leaf: Shard) -> Column:
    """-ln(u)/weight with u in (0, 1] from 53 bits of the hash of key and shard."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(leaf.shard)), 11)
    return -F.ln((bits + F.lit(1)).cast("double") * F.lit(2.0 ** -53)) / F.lit(float(leaf.weight))


def _least(children: list[Column]) -> Column:
    """Of structs (draw, ...): the one with the least draw, on ties with the least name."""
    return F.least(*children) if len(children) > 1 else children[0]


def place(key: Column, tree: list[Shard]) -> Column:
    """Struct (draw, region, rack, shard) of the shard that the descent ends in."""
    regions: dict[int, dict[int, list[Shard]]] = {}
    for leaf in sorted(tree):
        if leaf.weight > 0:
            regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    if not regions:
        raise ValueError("the tree has no shard with a weight")
    of_region = []
    for racks in regions.values():
        of_rack = [_least([F.struct(draw(key, leaf).alias("draw"), F.lit(leaf.region).alias("region"),
                                    F.lit(leaf.rack).alias("rack"), F.lit(leaf.shard).alias("shard"))
                           for leaf in leaves]) for leaves in racks.values()]
        of_region.append(_least(of_rack))
    return _least(of_region)


def assign(docs: DataFrame, tree: list[Shard], grown: list[Shard] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, region, rack, shard, and the shard in a grown tree; no shuffle."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    out = docs.select(
        "doc_id", (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        place(F.col("doc_id"), tree).alias("_at"),
        (place(F.col("doc_id"), grown)["shard"] if grown else F.lit(None).cast("int")).alias("grown_shard"))
    return out.select("doc_id", "size", "text_crc32", "_at.region", "_at.rack", "_at.shard", "grown_shard")


def with_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `slot`: 0, 1, ... inside each shard along `order`.

    A shard may hold any share of all rows, so no window spans a shard: rows are cut into ranges along `order`, ranked in
    (range, shard), and the counts of the ranges before are added. Those counts are one row per range and shard.
    """
    # Written once: cut again, the ranges could have other bounds, and ranks and counts would not fit together.
    ranged = materialise(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "shard-ranges")
    inside = W.partitionBy("_range", "shard").orderBy(*order)
    ranked = ranged.withColumn("_inner", F.row_number().over(inside))
    sizes = ranged.groupBy("_range", "shard").agg(F.count(F.lit(1)).alias("_rows"))
    along = W.partitionBy("shard").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("_range", "shard", F.coalesce(F.sum("_rows").over(along), F.lit(0)).alias("_before"))
    return (ranked.join(before, ["_range", "shard"])
            .withColumn("slot", (F.col("_inner") - 1 + F.col("_before")).cast("long")).drop("_range", "_inner", "_before"))


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """Every row with its shard among `shards`, the shard it would have among one more, and its slot."""
    placed = assign(docs, even_tree(shards), even_tree(shards + 1))
    return with_slots(placed, ["doc_id", "size", "text_crc32"]).withColumn("law", F.lit("key"))


def write_shards(docs: DataFrame, path: str, shards: int) -> None:
    """The documents themselves, one folder per shard; a hot shard is still written by many tasks."""
    at = place(F.col("doc_id"), even_tree(shards))["shard"]
    docs.withColumn("shard", at).write.partitionBy("shard").parquet(path)
