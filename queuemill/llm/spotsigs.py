"""SpotSigs document fingerprints. DataFrame functions only.

Common words (anchors) start a signature each: the anchor and the CHAIN next content words (words that are no anchors) after
it. The digests of a text's signatures, as a set, are its fingerprint; texts are alike by the Jaccard ratio of their sets. A text
with words but without a signature has one, made of all its words, so only texts without any word have an empty set.

Near duplicates are searched among sets of similar length: lengths are cut into partitions whose bounds grow by 1 / threshold, so
that a set can only be like sets of its own partition and the next. There, sets meet by their rarest signatures alone (a pair
above the threshold shares one of the first n - ceil(threshold * n) + 1 in any fixed order), and pairs whose lengths rule
the threshold out are dropped before they are compared.

Equal texts have equal fingerprints. Null and empty texts have an empty fingerprint, alike (1) to each other and not (0) to any
other. Ties and repeated rows keep their rows; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuemill.llm.components import components
from queuemill.runtime import materialise

CHAIN = 2
#: Frequent function words of four languages.
ANCHORS = tuple("""the of and to in is that it for was on are as with be by this at an or from have has not but he she they his her
der die das und ist von mit den dem des ein eine einen für auf im zu nicht auch sich als an es war wie bei
le la les de des du un une et est dans en que qui pour sur pas par au avec ce se il elle plus
el los las del que y en por con para una su al lo como más pero sus a no""".split())


def words_of(text: Column) -> Column:
    """Letters and digits in small letters; everything else parts words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`, the sorted set of signature digests of column `text`."""
    anchor = lambda w: w.isin(*ANCHORS)
    n = F.size("_words")
    at = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: anchor(F.get("_words", i)))
    # The j-th anchor, at place i, has i - j content words before it.
    chain = F.transform("_at", lambda i, j: F.when(i - j < F.size("_content"), F.xxhash64(
        F.get("_words", i), *[F.coalesce(F.get("_content", i - j + k), F.lit("")) for k in range(CHAIN)])))
    own = F.array_sort(F.array_distinct(F.filter(chain, lambda h: h.isNotNull())))
    return (df.withColumn("_words", words_of(F.col(text))).withColumn("_content", F.filter("_words", lambda w: ~anchor(w)))
            .withColumn("_at", at).withColumn("_own", own)
            .withColumn(out, F.when((F.size("_own") == 0) & (F.size("_words") > 0), F.array(F.xxhash64("_words"))).otherwise(F.col("_own")))
            .drop("_words", "_content", "_at", "_own"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard ratio of two sets; two empty ones are alike."""
    shared = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - shared
    return F.when(both == 0, 1.0).otherwise(shared / F.greatest(both, F.lit(1)))


def fingerprint(signatures: Column) -> Column:
    return F.array_join(F.transform(signatures, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), " ")


def length_partition(n: Column, threshold: float) -> Column:
    return F.floor(F.ln(F.greatest(n, F.lit(1)).cast("double")) / F.lit(-_ln(threshold))).cast("int")


def _ln(x: float) -> float:
    from math import log
    return log(x)


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_signatures and class_id (the least doc_id connected by pairs of at least `threshold`)."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sets = materialise(with_signatures(base, "text", "sigs").select("doc_id", "sigs").withColumn("name", F.xxhash64("sigs")), "spot-sets")
    # Equal sets are one; the least document stands for it.
    one = sets.where("size(sigs) > 0").groupBy("name").agg(F.min("doc_id").alias("id"), F.any_value("sigs").alias("sigs"))
    df = one.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    n = F.size("sigs")
    prefix = (n - F.ceil(F.lit(threshold) * n) + 1).cast("int")
    ranked = (one.select("id", n.alias("n"), prefix.alias("prefix"), F.explode("sigs").alias("sig")).join(df, "sig")
              .withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("df", "sig"))))
    keys = ranked.where("place <= prefix AND df > 1").select("sig", "id", "n", length_partition(F.col("n"), threshold).alias("part"))
    # Each set is asked for in its own length partition and the one below.
    left = keys.select("sig", "part", F.col("id").alias("a"), F.col("n").alias("na"))
    right = keys.select("sig", F.explode(F.array("part", F.col("part") - 1)).alias("part"), F.col("id").alias("b"), F.col("n").alias("nb"))
    pairs = (left.join(right, ["sig", "part"]).where((F.col("a") != F.col("b")) & (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb")))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    first, second = one.select(F.col("id").alias("a"), F.col("sigs").alias("x")), one.select(F.col("id").alias("b"), F.col("sigs").alias("y"))
    near = pairs.join(first, "a").join(second, "b").where(likeness(F.col("x"), F.col("y")) >= threshold).select("a", "b")
    same = sets.join(one.select("name", "id"), "name").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    found = components(near.unionByName(same), "spot-classes").withColumnsRenamed({"node": "doc_id"})
    return (sets.join(found, "doc_id", "left")
            .select("doc_id", F.size("sigs").cast("long").alias("n_signatures"), F.coalesce("component", "doc_id").alias("class_id")))


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text, sigs, and the text and signatures of the next document by doc_id; after the last comes the first.

    Documents are dealt into ranges of ids, and each range also gets the first document of the next one, as a row that only
    serves its neighbour. A null id counts as the least number.
    """
    spark = docs.sparkSession
    order = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_order", order)
    many = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = base.agg(F.percentile_approx("_order", [k / many for k in range(many + 1)], 20 * many).alias("q"), F.min("_order").alias("low")).first()
    if cuts["low"] is None:
        bounds = [0]
    else:
        bounds = sorted({cuts["low"], *cuts["q"]})        # one number a range, each the id of a document
    # Found in two steps, so that many ranges cost little.
    step = max(1, int(len(bounds) ** 0.5))
    fine = F.array(*[F.array(*[F.lit(b).cast("long") for b in bounds[k:k + step]]) for k in range(0, len(bounds), step)])
    coarse = F.array(*[F.lit(b).cast("long") for b in bounds[::step]])
    block = F.size(F.filter(coarse, lambda b: b <= F.col("_order"))) - 1
    rows = base.withColumn("_block", block).withColumn(
        "_range", F.col("_block") * step + F.size(F.filter(F.get(fine, F.col("_block")), lambda b: b <= F.col("_order"))) - 1).drop("_block")
    rows = with_signatures(rows, "text", "sigs")
    opens = F.col("_order").isin([int(b) for b in bounds])
    guests = F.when(F.col("_range") > 0, F.col("_range") - 1).otherwise(len(bounds) - 1)
    both = rows.withColumn("_at", F.explode(F.when(opens, F.array(F.struct(F.col("_range").alias("range"), F.lit(False).alias("guest")),
                                                                  F.struct(guests.alias("range"), F.lit(True).alias("guest"))))
                                           .otherwise(F.array(F.struct(F.col("_range").alias("range"), F.lit(False).alias("guest"))))))
    # Plain columns and one window: each further one would move the texts again.
    flat = both.select("doc_id", "_order", "text", "sigs", F.col("_at.range").alias("_in"), F.col("_at.guest").alias("_guest"))
    along = W.partitionBy("_in").orderBy("_guest", "_order", "text")
    return (flat.select("doc_id", "text", "sigs", "_guest", F.lead(F.struct("text", "sigs")).over(along).alias("_next"))
            .where("NOT _guest").select("doc_id", "text", "sigs", F.col("_next.text").alias("next_text"), F.col("_next.sigs").alias("next_sigs")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its text with the last quarter replaced by the beginning of the next document's
    text, and how alike the document's is to that one and to the next document's."""
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = neighbours(docs).withColumn("n_chars", n.cast("long")).withColumn("_edited", edited)
    rows = with_signatures(rows, "_edited", "edited_sigs")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        F.size("sigs").cast("long").alias("n_signatures"), length_partition(F.size("sigs"), 0.8).alias("length_partition"))
