"""Past resolutions for new tickets: ranked matches, blends, metrics and distinct fixes.

Ranked tables: query_id, candidate_id, score, rank; with facts: query_pid, candidate_pid, resolution.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuemill import fixed
from queuemill.functions import scalars as S
from queuemill.functions import text as X
from queuemill.functions import vectors as VX
from queuemill.operators import postings as POST
from queuemill.operators import similarity as SIM
from queuemill.runtime import ratio, rounded


def semantic_topk(queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return SIM.topk(SIM.dense_queries(queries, key, vector), SIM.dense_corpus(corpus, key, vector), k).drop("variant")


def sparse_queries(df: DataFrame, key: str, exclude: str | None = None, variant: Column | None = None) -> DataFrame:
    return df.select(
        F.col(key).cast("long").alias("query_id"), (variant if variant is not None else F.lit(0)).cast("long").alias("variant"),
        (F.col(exclude) if exclude else F.lit(None)).cast("long").alias("exclude_id"),
        F.lit(None).cast("string").alias("scope"), "idx", "val")


def sparse_corpus(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("candidate_id"), F.lit("").alias("scope"), "idx", "val")


def lexical_topk(queries: DataFrame, corpus: DataFrame, k: int, key: str) -> DataFrame:
    return POST.topk(sparse_queries(queries, key), sparse_corpus(corpus, key), k).drop("variant")


def joined(df: DataFrame, dims: int, dense: str = "embedding") -> DataFrame:
    """The `dims` numbers of the dense vector and the term weights side by side; a row without one of them has zeros, or no terms."""
    zeros, none = F.array_repeat(F.lit(0.0), dims), lambda kind: F.array().cast(f"array<{kind}>")
    places = F.concat(F.sequence(F.lit(0), F.lit(dims - 1)) if dims else none("int"),
                      F.transform(F.coalesce("idx", none("int")), lambda i: (i + dims).cast("int")))
    return (df.withColumn("_val", F.concat(F.coalesce(F.col(dense), zeros), F.coalesce("val", none("double")))).withColumn("idx", places)
            .drop("val").withColumnRenamed("_val", "val"))


def dense_size(df: DataFrame, dense: str = "embedding") -> int:
    return df.select(F.size(dense).alias("n")).where("n > 0").agg(F.max("n")).first()[0] or 0


def hybrid_topk(queries: DataFrame, corpus: DataFrame, weight: float, k: int, key: str = "vec_id") -> DataFrame:
    """The best by a blend of two cosines."""
    dims = dense_size(corpus)
    return SIM.blend_topk(sparse_queries(joined(queries, dims), key), sparse_corpus(joined(corpus, dims), key), k, [weight], dims).drop("variant")


def leave_one_out(corpus: DataFrame, weights=fixed.BLEND_GRID, key: str = "vec_id") -> DataFrame:
    """The best other row for every row and weight, all weights in one pass."""
    dims = dense_size(corpus)
    rows = joined(corpus, dims)
    best = SIM.blend_topk(sparse_queries(rows, key, exclude=key), sparse_corpus(rows, key), 1, list(weights), dims)
    named = F.array(*[F.lit(w) for w in weights])[F.col("variant").cast("int")]
    return best.select(named.alias("w"), "variant", "query_id", "candidate_id", "score")


def choose_blend(corpus: DataFrame, weights=fixed.BLEND_GRID, key: str = "vec_id") -> DataFrame:
    """Leave-one-out Top-1 per weight; the first best weight is marked."""
    best = with_pids(leave_one_out(corpus, weights, key), corpus, corpus, key)
    scores = best.groupBy("variant", "w").agg(rounded(F.avg(_hit().cast("double"))).alias("top1"))
    # A handful of rows: one per weight.
    first = F.row_number().over(W.orderBy(F.desc("top1"), "variant"))
    return scores.withColumn("selected", first == 1).select("w", "top1", "selected")


def category_scope(queries: DataFrame, corpus: DataFrame, predicted: str, k: int, category: str = "category") -> DataFrame:
    """Adds `scope`: the predicted category where it holds at least k candidates, else NULL."""
    sizes = corpus.groupBy(F.col(category).alias("_category")).agg(F.count(F.lit(1)).alias("_size"))
    known = queries.join(sizes, F.col(predicted) == F.col("_category"), "left")
    return known.withColumn("scope", F.when(F.col("_size") >= k, F.col(predicted))).drop("_category", "_size")


def category_topk(queries: DataFrame, corpus: DataFrame, k: int, predicted: str, key: str = "vec_id",
                  vector: str = "embedding") -> DataFrame:
    scoped = category_scope(queries, corpus, predicted, k)
    return SIM.topk(SIM.dense_queries(scoped, key, vector, scope="scope"),
                    SIM.dense_corpus(corpus, key, vector, scope="category"), k).drop("variant")


def category_hybrid_topk(queries: DataFrame, corpus: DataFrame, weight: float, k: int, predicted: str, key: str = "vec_id") -> DataFrame:
    scoped = category_scope(queries, corpus, predicted, k)
    dims = dense_size(corpus)
    asked = joined(scoped, dims).select(F.col(key).cast("long").alias("query_id"), F.lit(0).cast("long").alias("variant"),
                                        F.lit(None).cast("long").alias("exclude_id"), "scope", "idx", "val")
    held = joined(corpus, dims).select(F.col(key).cast("long").alias("candidate_id"), F.col("category").alias("scope"), "idx", "val")
    return SIM.blend_topk(asked, held, k, [weight], dims).drop("variant")


def with_pids(ranked: DataFrame, queries: DataFrame, corpus: DataFrame, key: str = "vec_id") -> DataFrame:
    """Adds the problem of the query and of the candidate, and the candidate's resolution."""
    q = queries.select(F.col(key).alias("query_id"), F.col("pid").alias("query_pid"))
    c = corpus.select(F.col(key).alias("candidate_id"), F.col("pid").alias("candidate_pid"), "resolution")
    return ranked.join(q, "query_id").join(c, "candidate_id")


def _hit() -> Column:
    return F.coalesce(F.col("candidate_pid") == F.col("query_pid"), F.lit(False))


# ---------------------------------------------------------------- metrics over ranked rows

def per_query_metrics(ranked: DataFrame, ks=fixed.RANK_KS) -> DataFrame:
    """Per query: Top-K, Precision@K, Recall@K (over min(K, retrieved)) and reciprocal rank."""
    hit = _hit()
    within = {k: F.count_if(hit & (F.col("rank") <= k)) for k in ks}
    retrieved = F.count(F.lit(1))
    return ranked.groupBy("query_id").agg(
        *[(within[k] > 0).cast("double").alias(f"top_{k}") for k in ks],
        *[(within[k] / F.lit(float(k))).alias(f"precision_{k}") for k in ks],
        *[(within[k] / F.greatest(F.lit(1), F.least(F.lit(k), retrieved))).alias(f"recall_{k}") for k in ks],
        F.coalesce(1.0 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("mrr"))


def rank_metrics(ranked: DataFrame, n_queries: int | None = None, ks=fixed.RANK_KS, by: list[str] | None = None) -> DataFrame:
    """Means over the queries; queries without any retrieved row count 0 when n_queries is given."""
    names = [f"{m}_{k}" for m in ("top", "precision", "recall") for k in ks] + ["mrr"]
    per_query = per_query_metrics(ranked, ks) if not by else None
    if by:
        hit = ranked.withColumn("query_id", F.struct(*by, "query_id"))
        per_query = per_query_metrics(hit, ks).select(*[F.col(f"query_id.{c}").alias(c) for c in by], *names)
    total = F.lit(n_queries) if n_queries is not None else F.count(F.lit(1))
    return per_query.groupBy(*(by or [])).agg(*[rounded(F.sum(n) / total, 4).alias(n) for n in names])


def first_hit_rank(ranked: DataFrame) -> DataFrame:
    reciprocal = 1.0 / F.min(F.when(_hit(), F.col("rank")))
    return ranked.groupBy("query_id").agg(rounded(F.coalesce(reciprocal, F.lit(0.0))).alias("rr"))


def hit1(ranked: DataFrame) -> DataFrame:
    return ranked.where(F.col("rank") == 1).select("query_id", _hit().alias("hit"))


def variant_table(variants: dict[str, DataFrame]) -> DataFrame:
    """Metrics of each variant's ranked rows; the one with the best MRR is marked."""
    stacked = reduce(lambda a, b: a.unionByName(b), [
        df.select(F.lit(name).alias("variant_name"), "query_id", "rank", "query_pid", "candidate_pid")
        for name, df in variants.items()])
    table = rank_metrics(stacked, by=["variant_name"])
    order = F.create_map(*[F.lit(x) for i, name in enumerate(variants) for x in (name, i)])[F.col("variant_name")]
    # One row per variant.
    return table.withColumn("best", F.row_number().over(W.orderBy(F.desc("mrr"), order)) == 1)


# ---------------------------------------------------------------- similarity readings

def bands(ranked: DataFrame) -> DataFrame:
    label, rate, floor = S.applicability(F.col("score"))
    return ranked.withColumns({"band": label, "observed_transfer_rate": rate, "floor": floor})


def threshold_flags(ranked: DataFrame, strong=fixed.STRONG_MATCH, duplicate=fixed.DUPLICATE_HYBRID) -> DataFrame:
    """weak reads the raw similarity, the other marks read it rounded to four places."""
    shown = rounded(F.col("score"), 4)
    first = F.col("rank") == 1
    return ranked.withColumns({
        "weak": F.col("score") < strong, "can_resolve": shown >= fixed.RESOLVE_ABOVE,
        "strong_match": first & (shown >= strong), "duplicate": first & (shown >= duplicate)})


def transfer_rate_by_band(ranked: DataFrame) -> DataFrame:
    top = bands(ranked.where(F.col("rank") == 1))
    return top.groupBy("band", "floor").agg(F.count(F.lit(1)).alias("n"),
                                            rounded(F.avg(_hit().cast("double")), 4).alias("transfer_rate"))


def duplicate_precision(ranked: DataFrame, threshold=fixed.DUPLICATE_HYBRID) -> DataFrame:
    flagged = ranked.where((F.col("rank") == 1) & (rounded(F.col("score"), 4) >= threshold))
    return flagged.agg(F.count(F.lit(1)).alias("flagged"), rounded(ratio(F.count_if(_hit()), F.count(F.lit(1))), 4).alias("precision"))


# ---------------------------------------------------------------- distinct fixes

def group_exact_fix(ranked: DataFrame, k: int) -> DataFrame:
    """The top k of a query collapsed to distinct resolution texts."""
    return (ranked.where(F.col("rank") <= k).groupBy("query_id", "resolution").agg(
        F.count(F.lit(1)).alias("seen_in"), F.max("score").alias("best_score"), F.sum("score").alias("evidence"),
        F.min("rank").alias("first_rank"), F.min_by("candidate_pid", "rank").alias("pid"), F.first("query_pid").alias("query_pid")))


def all_same_fix_queries(ranked: DataFrame, k: int = fixed.SHOW_MATCHES) -> DataFrame:
    """How many distinct fixes the top k hold, and for how many queries."""
    distinct = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.count_distinct("resolution").alias("distinct_fixes"))
    return distinct.groupBy("distinct_fixes").agg(F.count(F.lit(1)).alias("queries"))


# Orderings of distinct fixes by name; the group met first wins a tie.
FIX_STRATEGIES = {
    "Top single similarity": lambda: [F.desc("best_score"), "first_rank"],
    "Most tickets agreeing": lambda: [F.desc("seen_in"), F.desc("best_score"), "first_rank"],
    "Summed similarity": lambda: [F.desc(F.round("evidence", 9)), "first_rank"],
}


def rank_fixes(ranked: DataFrame, ks=fixed.FIX_KS) -> DataFrame:
    """For each K and ordering: distinct fixes shown and how often the first one applies."""
    tables = []
    for k in ks:
        groups = group_exact_fix(ranked, k)
        places = {f"p{i}": F.row_number().over(W.partitionBy("query_id").orderBy(*order()))
                  for i, order in enumerate(FIX_STRATEGIES.values())}
        placed = groups.withColumns(places)
        applies = F.coalesce(F.col("pid") == F.col("query_pid"), F.lit(False))
        per_query = placed.groupBy("query_id").agg(
            F.count(F.lit(1)).alias("shown"),
            *[F.max(F.when(F.col(p) == 1, applies.cast("int"))).alias(p) for p in places])
        one = per_query.agg(F.avg("shown").alias("shown"), *[F.avg(p).alias(p) for p in places])
        rows = [F.struct(F.lit(k).cast("long").alias("retrieved"), F.lit(name).alias("ranking"),
                         rounded(F.col("shown"), 2).alias("distinct_shown"), rounded(F.col(p), 4).alias("top1_applies"))
                for name, p in zip(FIX_STRATEGIES, places)]
        tables.append(one.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    return reduce(lambda a, b: a.unionByName(b), tables)


GROUP = "struct<resolution:string,fix:array<string>,seen_in:bigint,tickets:array<bigint>,similarity:double,evidence:double>"


def merge_near_fixes(ranked: DataFrame, k: int = fixed.GROUP_FROM, show: int | None = None) -> DataFrame:
    """Greedy merge in rank order: a match joins the first group whose founder has the same text or
    nearly the same words. At most k matches per query, folded inside one row."""
    match = F.struct("rank", F.col("candidate_id").alias("ticket"), F.trim(F.coalesce("resolution", F.lit(""))).alias("resolution"),
                     X.fix_tokens(F.trim(F.coalesce("resolution", F.lit("")))).alias("fix"), rounded(F.col("score"), 4).alias("similarity"))
    lists = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.sort_array(F.collect_list(match)).alias("m"))

    def add(groups, m):
        joins = lambda g: (g["resolution"] == m["resolution"]) | X.same_fix(g["fix"], m["fix"])
        hits = F.transform(groups, joins)
        at = F.array_position(hits, True)
        grown = F.transform(groups, lambda g, i: F.when(i + 1 == at, F.struct(
            g["resolution"].alias("resolution"), g["fix"].alias("fix"), (g["seen_in"] + 1).alias("seen_in"),
            F.concat(g["tickets"], F.array(m["ticket"])).alias("tickets"), g["similarity"].alias("similarity"),
            (g["evidence"] + m["similarity"]).alias("evidence"))).otherwise(g))
        founded = F.concat(groups, F.array(F.struct(
            m["resolution"].alias("resolution"), m["fix"].alias("fix"), F.lit(1).cast("bigint").alias("seen_in"),
            F.array(m["ticket"]).alias("tickets"), m["similarity"].alias("similarity"), m["similarity"].alias("evidence"))))
        return F.when(at > 0, grown).otherwise(founded).cast(f"array<{GROUP}>")

    merged = lists.select("query_id", F.aggregate("m", F.array().cast(f"array<{GROUP}>"), add).alias("g"))
    groups = merged.select("query_id", F.posexplode("g").alias("met", "g")).select("query_id", "met", "g.*")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("evidence", 9)), "met"))
    placed = groups.withColumn("place", place.cast("long"))
    if show:
        placed = placed.where(F.col("place") <= show)
    return placed.select("query_id", "place", "resolution", "seen_in", "tickets", "similarity", rounded(F.col("evidence"), 4).alias("evidence"))


def retrieve_batch(ranked: DataFrame, threshold=fixed.STRONG_MATCH) -> DataFrame:
    """The full answer per query: five matches, four fixes, and the marks drawn from the best match."""
    flagged = threshold_flags(ranked, strong=threshold)
    shown = F.struct("rank", "candidate_id", rounded(F.col("score"), 4).alias("similarity"), "resolution", "weak")
    answers = flagged.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("rank") <= fixed.SHOW_MATCHES, shown))).alias("matches"),
        F.max_by(F.when(F.col("duplicate"), F.col("candidate_id")), -F.col("rank")).alias("duplicate_of"),
        F.bool_or("strong_match").alias("strong_match"), rounded(F.max("score"), 4).alias("top_similarity"))
    label, rate, _ = S.applicability(F.col("similarity"))
    fix = F.struct("place", "resolution", "seen_in", "tickets", "similarity", "evidence", label.alias("band"),
                   rate.alias("observed_transfer_rate"), (F.col("similarity") >= fixed.RESOLVE_ABOVE).alias("can_resolve"))
    fixes = merge_near_fixes(ranked, show=fixed.SHOW_FIXES).groupBy("query_id").agg(F.sort_array(F.collect_list(fix)).alias("resolutions"))
    return answers.join(fixes, "query_id")


def shared_neighbourhood(ranked: DataFrame, k: int = fixed.RETRIEVE) -> DataFrame:
    """Neighbours that carry a resolution, ranked again after the cut to the neighbourhood."""
    kept = ranked.where(F.trim(F.coalesce("resolution", F.lit(""))) != "").drop("rank")
    return SIM.ranked(kept, k, keys=("query_id",))
