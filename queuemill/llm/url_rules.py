"""URL filter: a sort-merge range join of URLs with host and path rules. DataFrame functions only.

A rule (host, path, verdict) fits a host and all its subdomains if the URL's path starts with the rule's. Its canonical
key is the host with its labels reversed, a byte that no UTF-8 text has, and the path: all paths below one rule of
one host are the interval from that key to the key followed by byte FF. A URL asks once for each ending of its host that
has rules. Prefix intervals nest, so a sweep over the sorted rules keeps a stack: a start pushes its rule, an end pops
it, and what lies on top holds until the next of these bounds. The sorted questions then take the last bound before them.

The longest rule wins (host and path together; on a tie the longer host). A URL without a fitting rule gets the default
verdict and a null rule. A null URL, or one without `://`, has an empty host and path. Repeated URLs are judged one by one
and spread over ranges, rule lists may be empty, extra columns are ignored. Of rules with the same host and path one that
blocks holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuemill.runtime import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rule bounds are folded in blocks of at most about so many.
BLOCK = 2048


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _key(host: Column, path: Column) -> Column:
    reverse = F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")
    return F.concat(reverse.cast("binary"), F.unhex(F.lit("FE")), path.cast("binary"))


def _segments(rules: DataFrame) -> DataFrame:
    """(key, top): from `key` on, `top` is the innermost rule, or null outside all rules.

    The bounds are cut into ranges. Each range is one sorted array, folded with the stack as state; it starts with the
    rules that were begun in earlier ranges and end in or after it, at most as many as rules nest, shortest first.
    """
    rule = F.struct("host", "path", "verdict")
    start = F.col("key")
    closed = F.concat(start, F.unhex(F.lit("FF")))
    distinct = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", _key(F.col("host"), F.col("path")))
    bounds = distinct.select(F.explode(F.array(
        F.struct(start.alias("key"), F.lit(1).alias("opens"), start.alias("of"), rule.alias("rule")),
        F.struct(closed.alias("key"), F.lit(0).alias("opens"), start.alias("of"), rule.alias("rule")))).alias("b")).select("b.*")
    parts = F.floor(F.monotonically_increasing_id() % F.lit(1 << 33) / F.lit(BLOCK))
    # Written once: cut again, the ranges could have other bounds.
    ranged = materialise(bounds.repartitionByRange("key", "of").sortWithinPartitions("key", "of")
                         .withColumn("_block", F.spark_partition_id() * F.lit(1 << 31) + parts), "rule-bounds")
    blocks = ranged.groupBy("_block").agg(F.array_sort(F.collect_list(F.struct("key", "opens", "of", "rule"))).alias("_events"),
                                          F.min("key").alias("_low"))
    # Which rules are open where a block begins: begun in an earlier block, ended in this or a later one.
    numbers = blocks.select("_block", F.row_number().over(W.orderBy("_block")).alias("_no"))
    spans = (ranged.join(numbers, "_block").groupBy("of")
             .agg(F.min("_no").alias("_first"), F.max("_no").alias("_last"), F.any_value("rule").alias("rule")).where("_first < _last"))
    carried = (spans.select("of", "rule", F.explode(F.expr("sequence(_first + 1, _last)")).alias("_no"))
               .groupBy("_no").agg(F.array_sort(F.collect_list(F.struct("of", "rule"))).alias("_open"))
               .join(numbers, "_no").select("_block", "_open"))
    entry = "struct<of:binary,rule:struct<host:string,path:string,verdict:string>>"
    out = "array<struct<key:binary,top:struct<host:string,path:string,verdict:string>>>"

    def step(state: Column, e: Column) -> Column:
        stack = F.when(e["opens"] == 1, F.concat(state["stack"], F.array(F.struct(e["of"].alias("of"), e["rule"].alias("rule"))))
                       ).otherwise(F.slice(state["stack"], 1, F.greatest(F.size(state["stack"]) - 1, F.lit(0))))
        return F.struct(stack.alias("stack"), F.concat(state["out"], F.array(F.struct(
            e["key"].alias("key"), F.try_element_at(stack, F.lit(-1))["rule"].alias("top")))).cast(out).alias("out"))

    begin = F.struct(F.coalesce(F.col("_open"), F.array()).cast(f"array<{entry}>").alias("stack"), F.array().cast(out).alias("out"))
    return (blocks.join(carried, "_block", "left")
            .select(F.explode(F.aggregate("_events", begin, step, lambda s: s["out"])).alias("s")).select("s.key", "s.top"))


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """id_col, host, path, rule (`host` + `path`, or null), verdict, for every row of `urls`."""
    # Equal rows are judged once and written as often as they came.
    pages = (urls.select(F.col(id_col).alias("_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
             .groupBy("_id", "host", "path").agg(F.count(F.lit(1)).cast("int").alias("_n")))
    labels = F.split("host", r"\.", -1)
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    asked = pages.select("*", F.explode(endings).alias("_ending"))
    hosts = rules.select(F.col("host").alias("_ending"), F.lit(True).alias("_ruled")).distinct()
    # Endings without rules need not ask; the whole host always does, so that every row has an answer.
    asked = (asked.join(hosts, "_ending", "left").where("_ruled OR _ending = host")
             .select(_key(F.col("_ending"), F.col("path")).alias("key"), "_id", "host", "path", "_n"))
    segments = materialise(_segments(rules), "rule-segments")
    sides = (asked.withColumn("_asks", F.lit(1)).withColumn("top", F.lit(None).cast(segments.schema["top"].dataType))
             .unionByName(segments.withColumn("_asks", F.lit(0)), allowMissingColumns=True))
    # Bounds sort before equal questions; the ids spread one hot URL over ranges.
    order = ["key", "_asks", "_id", "host"]
    swept = materialise(sides.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "url-sweep")
    # A range without a bound of its own starts with the last one of the ranges before; one row per range.
    held = F.struct("top")
    last = swept.groupBy("_range").agg(F.max_by(held, F.when(F.col("_asks") == 0, F.struct("key"))).alias("_end"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carry = last.select("_range", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    upto = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    found = (swept.withColumn("_held", F.last(F.when(F.col("_asks") == 0, held), ignorenulls=True).over(upto))
             .where("_asks = 1").join(carry, "_range")
             .select("_id", "host", "path", "_n", F.coalesce("_held", "_carried")["top"].alias("_top")))
    size = F.struct(F.length("_top.host") + F.length("_top.path"), F.length("_top.host"))
    best = (found.groupBy("_id", "host", "path", "_n").agg(F.max_by("_top", F.when(F.col("_top").isNotNull(), size)).alias("_best"))
            .withColumn("_copy", F.explode(F.expr("sequence(1, _n)"))))
    return best.select(F.col("_id").alias(id_col), "host", "path", F.concat("_best.host", "_best.path").alias("rule"),
                       F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
