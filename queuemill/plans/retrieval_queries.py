"""Queries over vectors, texts and past resolutions, each with its check."""

from pyspark.sql import functions as F

from queuemill import fixed
from queuemill.functions import text as X
from queuemill.functions import vectors as VX
from queuemill.operators import lexical as LX
from queuemill.operators import retrieval as R
from queuemill.operators import sampling as SA
from queuemill.plans import views as V
from queuemill.plans.registry import query, with_ctes
from queuemill.plans.screening_queries import clean_sql, long_array, long_array_sql
from queuemill.plans.shared_frames import split
from queuemill.runtime import rounded, spread, table

QC = [V.VECTORS, V.SPLIT, ("q", "SELECT * FROM sp WHERE split = 'test'"),
      ("c", "SELECT * FROM sp WHERE split = 'train' AND trim(resolution) <> ''")]
SEM = ("sem", """
SELECT q.vec_id AS query_id, c.vec_id AS candidate_id, round(list_dot_product(q.embedding, c.embedding), 9) + 0.0 AS score FROM q, c""")
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id)"


def ranked_cte(source="sem", name="rk"):
    return (name, f"""
SELECT s.*, q.pid AS query_pid, c.pid AS candidate_pid, c.resolution
FROM (SELECT *, {_RANK} AS rank FROM {source}) s JOIN sp q ON q.vec_id = query_id JOIN sp c ON c.vec_id = candidate_id
WHERE rank <= 15""")


RK = [*QC, SEM, ranked_cte()]


def two_sides(spark, sf):
    both = split(spark, sf)
    queries = both.where("split = 'test'")
    corpus = both.where("split = 'train' AND trim(resolution) <> ''")
    return queries, corpus


def ranked_semantic(spark, sf, k=fixed.GROUP_FROM):
    queries, corpus = two_sides(spark, sf)
    return R.with_pids(R.semantic_topk(queries, corpus, k), queries, corpus)


# ---------------------------------------------------------------- vectors

@query("unit_rows", long_array_sql("embeddings", "vec_id", """
list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-9))"""))
def unit_rows(spark, sf):
    return long_array(table(spark, sf, "embeddings"), "vec_id", VX.unit(VX.doubles(F.col("embedding"))))


@query("embedding_ingest", """
SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims, round(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 4) AS length,
  CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS peak FROM embeddings""")
def embedding_ingest(spark, sf):
    vector = VX.doubles(F.col("embedding"))
    return table(spark, sf, "embeddings").select(
        "vec_id", F.size("embedding").cast("long").alias("dims"), rounded(VX.norm(vector), 4).alias("length"),
        VX.argmax(vector).alias("peak"))


def _topk_sql(k, source="sem"):
    return f"SELECT query_id, candidate_id, round(score, 6) AS score, rank FROM (SELECT *, {_RANK} AS rank FROM {source}) WHERE rank <= {k}"


def _shown(df):
    return df.select("query_id", "candidate_id", rounded(F.col("score")).alias("score"), "rank")


@query("similarity_join", with_ctes([V.VECTORS, ("q", "SELECT * FROM vx"), ("c", "SELECT * FROM vx"), SEM], _topk_sql(25)))
def similarity_join(spark, sf):
    every = V.vectors(spark, sf)
    return _shown(R.semantic_topk(every, every, 25))


@query("semantic_topk", with_ctes([*QC, SEM], _topk_sql(10)))
def semantic_topk(spark, sf):
    queries, corpus = two_sides(spark, sf)
    return _shown(R.semantic_topk(queries, corpus, fixed.RETRIEVE))


@query("topk_per_query", """
SELECT user_id AS query_id, event_id AS candidate_id, round(value, 6) AS score, rk AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rk FROM events) WHERE rk <= 3""")
def topk_per_query(spark, sf):
    scored = table(spark, sf, "events").select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("candidate_id"), F.col("value").alias("score"))
    return _shown(R.SIM.ranked(scored, 3, keys=("query_id",)))


SCOPED = ("scoped", """
SELECT q.*, CASE WHEN nn >= 10 THEN predicted END AS scope FROM (
  SELECT *, CASE WHEN vec_id % 10 = 0 THEN 'cat_none' ELSE category END AS predicted FROM q) q
LEFT JOIN (SELECT category AS cc, count(*) AS nn FROM c GROUP BY 1) ON cc = predicted""")
CSEM = ("csem", """
SELECT q.vec_id AS query_id, c.vec_id AS candidate_id, round(list_dot_product(q.embedding, c.embedding), 9) + 0.0 AS score
FROM scoped q JOIN c ON q.scope IS NULL OR q.scope = c.category""")


def predicted_sides(spark, sf):
    queries, corpus = two_sides(spark, sf)
    predicted = F.when(F.col("vec_id") % 10 == 0, "cat_none").otherwise(F.col("category"))
    return queries.withColumn("predicted", predicted), corpus


@query("category_restrict", with_ctes([*QC, SCOPED], "SELECT vec_id, predicted, scope FROM scoped"))
def category_restrict(spark, sf):
    queries, corpus = predicted_sides(spark, sf)
    return R.category_scope(queries, corpus, "predicted", fixed.RETRIEVE).select("vec_id", "predicted", "scope")


@query("category_topk", with_ctes([*QC, SCOPED, CSEM], _topk_sql(10, "csem")))
def category_topk(spark, sf):
    queries, corpus = predicted_sides(spark, sf)
    return _shown(R.category_topk(queries, corpus, fixed.RETRIEVE, "predicted"))


# ---------------------------------------------------------------- lexical

GRAMS = """
SELECT doc_id, unnest(toks || list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) AS term FROM (
  SELECT doc_id, list_filter(string_split(text, ' '), lambda w: length(w) >= 2) AS toks FROM lt)"""


def lexical_ctes(fit_on, docs="documents"):
    return [("lt", f"SELECT doc_id, {clean_sql('text')} AS text FROM {docs}"),
            ("gr", GRAMS), ("tf", "SELECT doc_id, term, count(*) AS tf FROM gr GROUP BY ALL"),
            ("fitd", fit_on), ("nd", "SELECT count(*) AS n FROM fitd"),
            ("voc", """SELECT term, df, ln((1.0::DOUBLE + n) / (1 + df)) + 1 AS idf FROM (
               SELECT term, count(*) AS df, sum(tf) AS cf, any_value(n) AS n FROM tf JOIN fitd USING (doc_id), nd GROUP BY term)
               WHERE df >= 2 AND df <= 0.85::DOUBLE * n ORDER BY cf DESC, term LIMIT 30000"""),
            ("w0", "SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN voc USING (term)"),
            ("wt", "SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w0")]


LEX = ("lex", """
SELECT a.doc_id AS query_id, b.doc_id AS candidate_id, sum(a.w * b.w) AS lex FROM wt a JOIN wt b USING (term)
WHERE a.doc_id IN (SELECT doc_id FROM lq) AND b.doc_id IN (SELECT doc_id FROM lc) GROUP BY ALL""")
_HELD_OUT = "substring(md5('42|' || doc_id), 1, 1) IN ('0','1','2')"
DOCS = [*lexical_ctes(f"SELECT doc_id FROM documents WHERE NOT {_HELD_OUT}"),
        ("lq", f"SELECT doc_id FROM documents WHERE {_HELD_OUT}"), ("lc", f"SELECT doc_id FROM documents WHERE NOT {_HELD_OUT}"), LEX,
        ("lsim", """SELECT lq.doc_id AS query_id, lc.doc_id AS candidate_id, round(coalesce(lex, 0), 9) + 0.0 AS score
          FROM lq CROSS JOIN lc LEFT JOIN lex ON query_id = lq.doc_id AND candidate_id = lc.doc_id""")]


def held_out(row_id):
    first = F.substring(F.md5(F.concat(F.lit("42|"), F.col(row_id).cast("string")).cast("binary")), 1, 1)
    return first.isin("0", "1", "2")


def documents(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", "text")


def _clean():
    return X.clean_text(F.col("text"))


def lexical_sides(spark, sf):
    docs = LX.tokens(documents(spark, sf), "doc_id", _clean())
    vocabulary = LX.Vocabulary.fit(docs.where(~held_out("doc_id")))
    sparse = R.SIM.materialise(LX.vectors(docs, "doc_id", vocabulary), "term-vectors")
    return sparse.where(held_out("doc_id")), sparse.where(~held_out("doc_id")), vocabulary


@query("tfidf", with_ctes(lexical_ctes(f"SELECT doc_id FROM documents WHERE NOT {_HELD_OUT}"), f"""
SELECT doc_id, term, round(w, 6) AS weight FROM wt WHERE NOT {_HELD_OUT}"""))
def tfidf(spark, sf):
    docs = LX.tokens(documents(spark, sf).where(~held_out("doc_id")), "doc_id", _clean())
    vocabulary = LX.Vocabulary.fit(docs)
    rows = LX.long_vectors(LX.vectors(docs, "doc_id", vocabulary), "doc_id", vocabulary)
    return rows.withColumn("weight", rounded(F.col("weight")))


@query("tfidf_transform", with_ctes(lexical_ctes(f"SELECT doc_id FROM documents WHERE NOT {_HELD_OUT}"), f"""
SELECT doc_id, term, round(w, 6) AS weight FROM wt WHERE {_HELD_OUT}"""))
def tfidf_transform(spark, sf):
    docs = LX.tokens(documents(spark, sf), "doc_id", _clean())
    vocabulary = LX.Vocabulary.fit(docs.where(~held_out("doc_id")))
    rows = LX.long_vectors(LX.vectors(docs.where(held_out("doc_id")), "doc_id", vocabulary), "doc_id", vocabulary)
    return rows.withColumn("weight", rounded(F.col("weight")))


@query("lexical_topk", with_ctes(DOCS, _topk_sql(10, "lsim")))
def lexical_topk(spark, sf):
    queries, corpus, _ = lexical_sides(spark, sf)
    return _shown(R.lexical_topk(queries, corpus, fixed.RETRIEVE, "doc_id"))


@query("positive_only", with_ctes(DOCS, _topk_sql(5, "lsim") + " AND score > 0"))
def positive_only(spark, sf):
    queries, corpus, _ = lexical_sides(spark, sf)
    return _shown(R.lexical_topk(queries, corpus, fixed.SHOW_MATCHES, "doc_id").where("score > 0"))


# ---------------------------------------------------------------- hybrid

HQC = [V.CASES, V.SPLIT, ("q", "SELECT * FROM sp WHERE split = 'test'"),
       ("c", "SELECT * FROM sp WHERE split = 'train' AND trim(resolution) <> ''"), SEM,
       *lexical_ctes("SELECT vec_id AS doc_id FROM c", "(SELECT vec_id AS doc_id, text FROM sp)"),
       ("lq", "SELECT vec_id AS doc_id FROM q"), ("lc", "SELECT vec_id AS doc_id FROM c"), LEX]


def hybrid_cte(weight, name="hyb"):
    return (name, f"""SELECT q.vec_id AS query_id, c.vec_id AS candidate_id,
  round({weight}::DOUBLE * list_dot_product(q.embedding, c.embedding) + (1 - {weight}::DOUBLE) * coalesce(lex, 0), 9) + 0.0 AS score
FROM q CROSS JOIN c LEFT JOIN lex ON query_id = q.vec_id AND candidate_id = c.vec_id""")


def hybrid_sides(spark, sf):
    both = R.SIM.materialise(SA.stratified_split(V.cases(spark, sf), "category", "vec_id"), "cases")
    cased = "split = 'train' AND trim(resolution) <> ''"
    words = LX.tokens(spread(both), "vec_id", _clean(), "split", "resolution")
    sparse = LX.vectors(words, "vec_id", LX.Vocabulary.fit(words.where(cased)))
    full = R.SIM.materialise(both.drop("text").join(sparse, "vec_id"), "hybrid-vectors")
    return full.where("split = 'test'"), full.where(cased)


@query("hybrid_topk", with_ctes([*HQC, hybrid_cte(0.5)], _topk_sql(10, "hyb")))
def hybrid_topk(spark, sf):
    queries, corpus = hybrid_sides(spark, sf)
    return _shown(R.hybrid_topk(queries, corpus, 0.5, fixed.RETRIEVE))


_GRID = ", ".join(f"({i}, {w}::DOUBLE)" for i, w in enumerate(fixed.BLEND_GRID))
LOO = [*[x for x in HQC if x[0] not in ("lq", "lex")], ("lq", "SELECT vec_id AS doc_id FROM c"), LEX,
       ("grid", f"SELECT * FROM (VALUES {_GRID}) g(variant, w)"),
       ("loo", """SELECT variant, w, query_id, candidate_id, score FROM (
         SELECT *, row_number() OVER (PARTITION BY variant, query_id ORDER BY score DESC, candidate_id) AS rank FROM (
           SELECT variant, w, a.vec_id AS query_id, b.vec_id AS candidate_id,
             round(w * list_dot_product(a.embedding, b.embedding) + (1 - w) * coalesce(lex, 0), 9) + 0.0 AS score
           FROM c a JOIN c b ON a.vec_id <> b.vec_id LEFT JOIN lex ON query_id = a.vec_id AND candidate_id = b.vec_id, grid))
         WHERE rank = 1""")]


@query("loo_self_join", with_ctes(LOO, "SELECT w, query_id, candidate_id, round(score, 6) AS score FROM loo"))
def loo_self_join(spark, sf):
    _, corpus = hybrid_sides(spark, sf)
    return R.leave_one_out(corpus).select("w", "query_id", "candidate_id", rounded(F.col("score")).alias("score"))


@query("choose_blend", with_ctes(LOO, """
SELECT w, top1, row_number() OVER (ORDER BY top1 DESC, variant) = 1 AS selected FROM (
  SELECT variant, w, round(avg(CASE WHEN a.pid = b.pid THEN 1.0 ELSE 0.0 END), 6) AS top1
  FROM loo JOIN sp a ON a.vec_id = query_id JOIN sp b ON b.vec_id = candidate_id GROUP BY variant, w)"""))
def choose_blend(spark, sf):
    _, corpus = hybrid_sides(spark, sf)
    return R.choose_blend(corpus)


# ---------------------------------------------------------------- metrics

def metrics_sql(source, by=""):
    key = f"{by}, " if by else ""
    per = ", ".join([f"CASE WHEN count(*) FILTER (hit AND rank <= {k}) > 0 THEN 1.0 ELSE 0.0 END AS top_{k}, "
                     f"count(*) FILTER (hit AND rank <= {k}) / {k}.0::DOUBLE AS precision_{k}, "
                     f"count(*) FILTER (hit AND rank <= {k})::DOUBLE / greatest(1, least({k}, count(*))) AS recall_{k}" for k in fixed.RANK_KS])
    names = [f"{m}_{k}" for m in ("top", "precision", "recall") for k in fixed.RANK_KS] + ["mrr"]
    means = ", ".join(f"round(avg({n}), 4) AS {n}" for n in names)
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {key}{means} FROM (SELECT {key}query_id, {per}, coalesce(1.0 / min(rank) FILTER (hit), 0.0) AS mrr
  FROM (SELECT *, query_pid = candidate_pid AS hit FROM {source}) GROUP BY {key}query_id) {group}"""


@query("rank_metrics", with_ctes([*RK, ("r10", "SELECT * FROM rk WHERE rank <= 10")], metrics_sql("r10")))
def rank_metrics(spark, sf):
    return R.rank_metrics(ranked_semantic(spark, sf, 10))


@query("first_hit_rank", with_ctes(RK, """
SELECT query_id, round(coalesce(1.0 / min(rank) FILTER (query_pid = candidate_pid), 0.0), 6) AS rr FROM rk WHERE rank <= 10 GROUP BY query_id"""))
def first_hit_rank(spark, sf):
    return R.first_hit_rank(ranked_semantic(spark, sf, 10))


@query("hit1_vector", with_ctes(RK, "SELECT query_id, query_pid = candidate_pid AS hit FROM rk WHERE rank = 1"))
def hit1_vector(spark, sf):
    return R.hit1(ranked_semantic(spark, sf, 10))


VARIANTS = [*HQC, SCOPED,
            ("csem", "SELECT s.* FROM sem s JOIN scoped q ON q.vec_id = query_id JOIN c ON c.vec_id = candidate_id WHERE q.scope IS NULL OR q.scope = c.category"),
            hybrid_cte(0.5),
            ("chyb", "SELECT s.* FROM hyb s JOIN scoped q ON q.vec_id = query_id JOIN c ON c.vec_id = candidate_id WHERE q.scope IS NULL OR q.scope = c.category"),
            *[ranked_cte(s, f"r_{s}") for s in ("sem", "csem", "hyb", "chyb")],
            ("vr", " UNION ALL ".join(f"SELECT '{n}' AS variant_name, {i} AS pos, * FROM r_{s} WHERE rank <= 10" for i, (n, s) in enumerate((
                ("Semantic retrieval", "sem"), ("Semantic + category context", "csem"),
                ("Semantic + lexical hybrid", "hyb"), ("Hybrid + category context", "chyb")))))]


@query("variant_table", with_ctes([*VARIANTS, ("vm", metrics_sql("vr", "variant_name")),
       ("ps", "SELECT DISTINCT variant_name, pos FROM vr")],
       "SELECT vm.*, row_number() OVER (ORDER BY mrr DESC, pos) = 1 AS best FROM vm JOIN ps USING (variant_name)"))
def variant_table(spark, sf):
    queries, corpus = hybrid_sides(spark, sf)
    predicted = F.when(F.col("vec_id") % 10 == 0, "cat_none").otherwise(F.col("category"))
    asked, k = queries.withColumn("predicted", predicted), fixed.RETRIEVE
    facts = lambda ranked: R.with_pids(ranked, queries, corpus)
    return R.variant_table({
        "Semantic retrieval": facts(R.semantic_topk(queries, corpus, k)),
        "Semantic + category context": facts(R.category_topk(asked, corpus, k, "predicted")),
        "Semantic + lexical hybrid": facts(R.hybrid_topk(queries, corpus, 0.5, k)),
        "Hybrid + category context": facts(R.category_hybrid_topk(asked, corpus, 0.5, k, "predicted"))})


# ---------------------------------------------------------------- readings of similarity

_BAND = "CASE " + " ".join(f"WHEN score >= {floor} THEN '{label}'" for floor, label, _ in fixed.APPLICABILITY) + " ELSE 'unlikely to apply' END"
_RATE = "CASE " + " ".join(f"WHEN score >= {floor} THEN {rate}::DOUBLE" for floor, _, rate in fixed.APPLICABILITY) + " ELSE 0.0 END"
_FLOOR = "CASE " + " ".join(f"WHEN score >= {floor} THEN {floor}::DOUBLE" for floor, _, _ in fixed.APPLICABILITY) + " ELSE 0.0 END"


DRK = [*DOCS, ("rk", f"""SELECT l.*, a.lang AS query_pid, b.lang AS candidate_pid FROM (SELECT *, {_RANK} AS rank FROM lsim) l
  JOIN documents a ON a.doc_id = query_id JOIN documents b ON b.doc_id = candidate_id WHERE rank <= 5""")]


def ranked_lexical(spark, sf):
    """Closest documents by their words; a candidate counts as relevant when the language agrees."""
    queries, corpus, _ = lexical_sides(spark, sf)
    lang = lambda side: table(spark, sf, "documents").select(F.col("doc_id").alias(f"{side}_id"), F.col("lang").alias(f"{side}_pid"))
    ranked = R.lexical_topk(queries, corpus, fixed.SHOW_MATCHES, "doc_id")
    return ranked.join(lang("query"), "query_id").join(lang("candidate"), "candidate_id")


@query("applicability_band", with_ctes(DRK, f"""
SELECT query_id, rank, {_BAND} AS band, {_RATE} AS observed_transfer_rate, {_FLOOR} AS floor FROM rk"""))
def applicability_band(spark, sf):
    return R.bands(ranked_lexical(spark, sf)).select("query_id", "rank", "band", "observed_transfer_rate", "floor")


@query("threshold_flags", with_ctes(DRK, """
SELECT query_id, rank, score < 0.5 AS weak, round(score, 4) >= 0.7 AS can_resolve,
  rank = 1 AND round(score, 4) >= 0.5 AS strong_match, rank = 1 AND round(score, 4) >= 0.85 AS duplicate FROM rk"""))
def threshold_flags(spark, sf):
    return R.threshold_flags(ranked_lexical(spark, sf)).select("query_id", "rank", "weak", "can_resolve", "strong_match", "duplicate")


@query("duplicate_flag", with_ctes(DRK, """
SELECT query_id, candidate_id AS duplicate_of FROM rk WHERE rank = 1 AND round(score, 4) >= 0.80"""))
def duplicate_flag(spark, sf):
    flagged = R.threshold_flags(ranked_lexical(spark, sf), duplicate=fixed.DUPLICATE_LEXICAL)
    return flagged.where("duplicate").select("query_id", F.col("candidate_id").alias("duplicate_of"))


@query("transfer_rate_by_band", with_ctes(DRK, f"""
SELECT {_BAND} AS band, {_FLOOR} AS floor, count(*) AS n, round(avg(CASE WHEN query_pid = candidate_pid THEN 1.0 ELSE 0.0 END), 4) AS transfer_rate
FROM rk WHERE rank = 1 GROUP BY 1, 2"""))
def transfer_rate_by_band(spark, sf):
    return R.transfer_rate_by_band(ranked_lexical(spark, sf))


@query("duplicate_precision", with_ctes(DRK, """
SELECT count(*) AS flagged, round(avg(CASE WHEN query_pid = candidate_pid THEN 1.0 ELSE 0.0 END), 4) AS precision
FROM rk WHERE rank = 1 AND round(score, 4) >= 0.85"""))
def duplicate_precision(spark, sf):
    return R.duplicate_precision(ranked_lexical(spark, sf))


# ---------------------------------------------------------------- fixes

_TOK = "list_sort(list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z]+'), lambda w: length(w) > 2)))"


@query("fix_tokens", with_ctes([V.VECTORS], f"SELECT vec_id, array_to_string({_TOK.format('resolution')}, ' ') AS tokens FROM vx"))
def fix_tokens(spark, sf):
    return V.vectors(spark, sf).select("vec_id", F.concat_ws(" ", F.sort_array(X.fix_tokens(F.col("resolution")))).alias("tokens"))


@query("fix_jaccard", with_ctes([V.VECTORS, ("tk", f"SELECT vec_id, pid, {_TOK.format('resolution')} AS t FROM vx"),
       ("fd", "SELECT pid, arg_min(t, vec_id) AS f FROM tk GROUP BY pid")], """
SELECT vec_id, round(coalesce(len(list_intersect(t, f))::DOUBLE / nullif(len(list_distinct(t || f)), 0), 0), 6) AS jaccard,
  len(t) > 0 AND len(f) > 0 AND coalesce(len(list_intersect(t, f))::DOUBLE / nullif(len(list_distinct(t || f)), 0), 0) >= 0.8 AS same_fix
FROM tk JOIN fd USING (pid)"""))
def fix_jaccard(spark, sf):
    tokens = V.vectors(spark, sf).select("vec_id", "pid", X.fix_tokens(F.col("resolution")).alias("t"))
    founder = tokens.groupBy("pid").agg(F.min_by("t", "vec_id").alias("f"))
    return tokens.join(founder, "pid").select(
        "vec_id", rounded(X.jaccard(F.col("t"), F.col("f"))).alias("jaccard"), X.same_fix(F.col("t"), F.col("f")).alias("same_fix"))


GROUPS = """SELECT query_id, resolution, count(*) AS seen_in, max(score) AS best_score, sum(score) AS evidence,
  min(rank) AS first_rank, arg_min(candidate_pid, rank) AS pid, any_value(query_pid) AS query_pid FROM rk WHERE rank <= {} GROUP BY query_id, resolution"""


@query("group_exact_fix", with_ctes(RK, f"""
SELECT query_id, resolution, seen_in, round(best_score, 6) AS best_score, round(evidence, 6) AS evidence, first_rank FROM ({GROUPS.format(10)})"""))
def group_exact_fix(spark, sf):
    groups = R.group_exact_fix(ranked_semantic(spark, sf, 10), 10)
    return groups.select("query_id", "resolution", "seen_in", rounded(F.col("best_score")).alias("best_score"),
                         rounded(F.col("evidence")).alias("evidence"), "first_rank")


@query("all_same_fix_queries", with_ctes(RK, """
SELECT distinct_fixes, count(*) AS queries FROM (SELECT query_id, count(DISTINCT resolution) AS distinct_fixes FROM rk WHERE rank <= 5 GROUP BY query_id)
GROUP BY distinct_fixes"""))
def all_same_fix_queries(spark, sf):
    return R.all_same_fix_queries(ranked_semantic(spark, sf, 5))


_ORDERS = {"Top single similarity": "best_score DESC, first_rank", "Most tickets agreeing": "seen_in DESC, best_score DESC, first_rank",
           "Summed similarity": "round(evidence, 9) DESC, first_rank"}
_FIXES = " UNION ALL ".join(f"""
SELECT CAST({k} AS BIGINT) AS retrieved, '{name}' AS ranking,
  round((SELECT avg(n) FROM (SELECT count(*) AS n FROM g{k} GROUP BY query_id)), 2) AS distinct_shown,
  round(avg(CASE WHEN pid = query_pid THEN 1.0 ELSE 0.0 END), 4) AS top1_applies
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS p FROM g{k}) WHERE p = 1"""
                            for k in fixed.FIX_KS for name, order in _ORDERS.items())
RANK_FIXES = with_ctes([*RK, *[(f"g{k}", GROUPS.format(k)) for k in fixed.FIX_KS]], _FIXES)


@query("rank_fixes", RANK_FIXES)
def rank_fixes(spark, sf):
    return R.rank_fixes(R.SIM.materialise(ranked_semantic(spark, sf), "ranked"))


@query("fix_strategies", with_ctes([*RK, ("g15", GROUPS.format(15))], """
SELECT query_id, resolution, row_number() OVER (PARTITION BY query_id ORDER BY best_score DESC, first_rank) AS by_top,
  row_number() OVER (PARTITION BY query_id ORDER BY seen_in DESC, best_score DESC, first_rank) AS by_count,
  row_number() OVER (PARTITION BY query_id ORDER BY round(evidence, 9) DESC, first_rank) AS by_sum FROM g15"""))
def fix_strategies(spark, sf):
    from pyspark.sql import Window as W
    groups = R.group_exact_fix(ranked_semantic(spark, sf), 15)
    place = lambda name: F.row_number().over(W.partitionBy("query_id").orderBy(*R.FIX_STRATEGIES[name]())).cast("long")
    return groups.select("query_id", "resolution", place("Top single similarity").alias("by_top"),
                         place("Most tickets agreeing").alias("by_count"), place("Summed similarity").alias("by_sum"))


MERGED = [*RK, ("mm", f"SELECT query_id, rank, candidate_id, trim(resolution) AS resolution, {_TOK.format('resolution')} AS fix, round(score, 4) AS sim FROM rk"),
          ("recursive_fold", "SELECT 1")]

# The greedy merge: each match in rank order joins the first group whose founder is near, found by recursion over ranks.
_NEAR = """(f.resolution = m.resolution OR (len(f.fix) > 0 AND len(m.fix) > 0 AND
  len(list_intersect(f.fix, m.fix))::DOUBLE / len(list_distinct(f.fix || m.fix)) >= 0.8))"""
MERGE_SQL = "WITH RECURSIVE " + ",\n".join(f"{n} AS ({t})" for n, t in MERGED[:-1]) + f""",
near AS (SELECT m.query_id, m.rank, f.rank AS founder FROM mm m JOIN mm f ON f.query_id = m.query_id AND f.rank < m.rank WHERE {_NEAR}),
cand AS (SELECT mm.query_id, mm.rank, coalesce(list(founder ORDER BY founder) FILTER (founder IS NOT NULL), []) AS cands
         FROM mm LEFT JOIN near USING (query_id, rank) GROUP BY ALL),
fold AS (SELECT query_id, 1::BIGINT AS rank, [1::BIGINT] AS founders, 1::BIGINT AS grp FROM cand WHERE rank = 1
  UNION ALL SELECT c.query_id, c.rank::BIGINT,
    CASE WHEN len(list_intersect(c.cands, f.founders)) > 0 THEN f.founders ELSE f.founders || [c.rank::BIGINT] END,
    CASE WHEN len(list_intersect(c.cands, f.founders)) > 0 THEN list_min(list_intersect(c.cands, f.founders)) ELSE c.rank END::BIGINT
  FROM fold f JOIN cand c ON c.query_id = f.query_id AND c.rank = f.rank + 1),
grp AS (SELECT query_id, fold.grp AS founder, count(*) AS seen_in, arg_min(mm.resolution, rank) AS resolution, arg_min(mm.sim, rank) AS similarity,
  sum(mm.sim) AS evidence, string_agg(candidate_id::VARCHAR, ',' ORDER BY rank) AS tickets FROM fold JOIN mm USING (query_id, rank) GROUP BY ALL),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(evidence, 9) DESC, founder) AS place FROM grp)
"""


@query("merge_near_fixes", MERGE_SQL + "SELECT query_id, place, resolution, seen_in, tickets, similarity, round(evidence, 4) AS evidence FROM pl")
def merge_near_fixes(spark, sf):
    merged = R.merge_near_fixes(ranked_semantic(spark, sf))
    return merged.withColumn("tickets", F.array_join(F.col("tickets").cast("array<string>"), ","))


@query("limit_options", MERGE_SQL + "SELECT query_id, place, resolution, seen_in FROM pl WHERE place <= 4")
def limit_options(spark, sf):
    merged = R.merge_near_fixes(ranked_semantic(spark, sf), show=fixed.SHOW_FIXES)
    return merged.select("query_id", "place", "resolution", "seen_in")


@query("retrieve_batch", MERGE_SQL + f"""
SELECT query_id, string_agg(candidate_id || ':' || printf('%.4f', round(score, 4)), ',' ORDER BY rank) FILTER (rank <= 5) AS matches,
  max(candidate_id) FILTER (rank = 1 AND round(score, 4) >= 0.85) AS duplicate_of,
  bool_or(rank = 1 AND round(score, 4) >= 0.5) AS strong_match, round(max(score), 4) AS top_similarity,
  any_value(fixes) AS fixes FROM rk JOIN (
    SELECT query_id, string_agg(seen_in || ':' || {_BAND.replace('score', 'similarity')} || ':' || resolution, '|' ORDER BY place) AS fixes
    FROM pl WHERE place <= 4 GROUP BY query_id) USING (query_id) GROUP BY query_id""")
def retrieve_batch(spark, sf):
    answers = R.retrieve_batch(ranked_semantic(spark, sf))
    match = lambda m: F.concat_ws(":", m["candidate_id"].cast("string"), F.format_string("%.4f", m["similarity"]))
    fix = lambda f: F.concat_ws(":", f["seen_in"].cast("string"), f["band"], f["resolution"])
    return answers.select("query_id", F.array_join(F.transform("matches", match), ",").alias("matches"), "duplicate_of",
                          "strong_match", "top_similarity", F.array_join(F.transform("resolutions", fix), "|").alias("fixes"))


@query("shared_neighbourhood", with_ctes([V.VECTORS, V.SPLIT, ("q", "SELECT * FROM sp WHERE split = 'test'"),
       ("c", "SELECT * FROM sp WHERE split = 'train'"), SEM, ranked_cte()], f"""
SELECT query_id, candidate_id, {_RANK} AS rank FROM rk WHERE trim(resolution) <> '' QUALIFY {_RANK} <= 10"""))
def shared_neighbourhood(spark, sf):
    both = split(spark, sf)
    queries, corpus = both.where("split = 'test'"), both.where("split = 'train'")
    ranked = R.with_pids(R.semantic_topk(queries, corpus, fixed.GROUP_FROM), queries, corpus)
    return R.shared_neighbourhood(ranked).select("query_id", "candidate_id", "rank")
