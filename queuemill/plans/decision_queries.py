"""Queries over the decision log and the feedback store, each with its check."""

from pyspark.sql import functions as F

from queuemill.functions import scalars as S
from queuemill.operators import decisions as D
from queuemill.operators import sampling as SA
from queuemill.operators.ranking import ordinal_segment
from queuemill.plans import views as V
from queuemill.plans.registry import query, with_ctes
from queuemill.runtime import rounded


def decisions(spark, sf):
    return D.validated(V.entries(spark, sf))


def examples(spark, sf):
    return D.to_examples(decisions(spark, sf))


def held(spark, sf):
    """The store as it was in mid-January: the earlier examples."""
    return examples(spark, sf).where("at < '2024-01-15'")


HELD = ("hd", "SELECT * FROM ex WHERE \"at\" < '2024-01-15'")


@query("override_flags", with_ctes(V.LOG, "SELECT decision_id, category_overridden, team_overridden FROM dc"))
def override_flags(spark, sf):
    return decisions(spark, sf).select("decision_id", "category_overridden", "team_overridden")


@query("truncate_fields", with_ctes(V.LOG, "SELECT decision_id, subject, description, text_before, text_after FROM dc"))
def truncate_fields(spark, sf):
    return decisions(spark, sf).select("decision_id", "subject", "description", "text_before", "text_after")


@query("coalesce_choice", with_ctes(V.LOG, """
SELECT decision_id, coalesce(nullif(chosen_category, ''), suggested_category) AS category,
  coalesce(nullif(chosen_team, ''), suggested_team) AS team FROM dc"""))
def coalesce_choice(spark, sf):
    pick = lambda what: S.choice(F.col(f"chosen_{what}"), F.col(f"suggested_{what}")).alias(what)
    return decisions(spark, sf).select("decision_id", pick("category"), pick("team"))


@query("provenance", with_ctes(V.LOG, """
SELECT decision_id, CASE WHEN enriched THEN 'enriched'
  WHEN rejected OR coalesce(referred_to <> '', false) OR category_overridden OR team_overridden THEN 'corrected'
  WHEN coalesce(chosen_category <> '', false) OR coalesce(chosen_team <> '', false) THEN 'confirmed' END AS provenance FROM dc"""))
def provenance(spark, sf):
    return decisions(spark, sf).select("decision_id", S.provenance().alias("provenance"))


_EX = """SELECT "at", arm, subject, description, category, assigned_team, provenance, rejected_only,
  round(confidence_before, 6) AS confidence_before, round(confidence_after, 6) AS confidence_after, text FROM {}"""


def _shown(df):
    return df.withColumns({c: rounded(F.col(c)) for c in ("confidence_before", "confidence_after")})


@query("to_examples", with_ctes([*V.LOG, V.EXAMPLES], _EX.format("ex")))
def to_examples(spark, sf):
    return _shown(examples(spark, sf))


@query("promote_new", with_ctes([*V.LOG, V.EXAMPLES, HELD], _EX.format("""(
  SELECT * FROM ex WHERE NOT EXISTS (SELECT 1 FROM hd WHERE hd."at" = ex."at" AND hd.subject = ex.subject
    AND hd.category = ex.category AND hd.assigned_team = ex.assigned_team))""")))
def promote_new(spark, sf):
    return _shown(D.promote_new(examples(spark, sf), held(spark, sf)))


_USABLE = "provenance IN ('corrected','enriched') AND category <> '' AND assigned_team <> '' AND NOT rejected_only"


@query("trainable_policy", with_ctes([*V.LOG, V.EXAMPLES], _EX.format(f"ex WHERE {_USABLE}")))
def trainable_policy(spark, sf):
    return _shown(D.trainable(examples(spark, sf)))


@query("policy_argument", with_ctes([*V.LOG, V.EXAMPLES],
       _EX.format(f"ex WHERE {_USABLE.replace(chr(39) + 'corrected' + chr(39) + ',', chr(39) + 'confirmed' + chr(39) + ',')}")))
def policy_argument(spark, sf):
    return _shown(D.trainable(examples(spark, sf), ("confirmed", "enriched")))


SUMMARY = """
SELECT count(*) AS total, count(*) FILTER (chosen_category <> '') AS category_decided,
  count(*) FILTER (chosen_category <> '' AND category_overridden) AS category_overridden,
  count(*) FILTER (chosen_team <> '') AS team_decided, count(*) FILTER (chosen_team <> '' AND team_overridden) AS team_overridden,
  count(*) FILTER (resolution_used <> '') AS resolutions_reused, count(*) FILTER (resolved_with <> '') AS resolved_from_past,
  count(*) FILTER (referred_to <> '') AS referred, count(*) FILTER (closed_as_duplicate_of <> '') AS closed_as_duplicate,
  count(*) FILTER (abstained) AS abstained, count(*) FILTER (rejected) AS rejected,
  count(*) FILTER (enriched AND confidence_before IS NOT NULL AND confidence_after IS NOT NULL) AS enriched,
  round(1 - count(*) FILTER (chosen_category <> '' AND category_overridden)::DOUBLE / count(*) FILTER (chosen_category <> ''), 3) AS category_accept_rate,
  round(1 - count(*) FILTER (chosen_team <> '' AND team_overridden)::DOUBLE / count(*) FILTER (chosen_team <> ''), 3) AS team_accept_rate,
  round(count(*) FILTER (referred_to <> '')::DOUBLE / count(*) FILTER (chosen_team <> ''), 3) AS referral_rate,
  round(avg(confidence_after - confidence_before) FILTER (enriched), 3) AS mean_confidence_lift FROM dc"""


@query("decision_summary", with_ctes(V.LOG, SUMMARY))
def decision_summary(spark, sf):
    return D.summary(decisions(spark, sf))


for _name, _columns in (("accept_rates", ["category_accept_rate", "team_accept_rate"]),
                        ("referral_rate", ["referral_rate"]), ("confidence_lift", ["mean_confidence_lift"])):
    query(_name, with_ctes(V.LOG, f"SELECT {', '.join(_columns)} FROM ({SUMMARY})"))(
        lambda spark, sf, columns=tuple(_columns): D.summary(decisions(spark, sf)).select(*columns))


_FLOWS = """SELECT suggested_team AS from_team, chosen_team AS to_team, count(*) AS n FROM dc
WHERE chosen_team <> '' AND team_overridden GROUP BY ALL ORDER BY n DESC, from_team, to_team LIMIT {}"""


@query("override_flows", with_ctes(V.LOG, _FLOWS.format(5)))
def override_flows(spark, sf):
    return D.override_flows(decisions(spark, sf))


@query("top_n_counts", with_ctes(V.LOG, _FLOWS.format(3)))
def top_n_counts(spark, sf):
    return D.override_flows(decisions(spark, sf), 3)


@query("last_n", with_ctes(V.LOG, "SELECT decision_id, arm, suggested_team FROM dc ORDER BY decision_id DESC LIMIT 5"))
def last_n(spark, sf):
    return D.last_n(decisions(spark, sf), 5).select("decision_id", "arm", "suggested_team")


@query("enrichment_examples", with_ctes(V.LOG, """
SELECT decision_id, substring(text_before, 1, 160) AS "before", substring(text_after, 1, 160) AS "after",
  round(confidence_before, 6) AS "from", round(confidence_after, 6) AS "to" FROM dc
WHERE enriched AND confidence_before IS NOT NULL AND confidence_after IS NOT NULL ORDER BY decision_id DESC LIMIT 3"""))
def enrichment_examples(spark, sf):
    shown = D.enrichment_examples(decisions(spark, sf))
    return shown.withColumns({"from": rounded(F.col("from")), "to": rounded(F.col("to"))})


@query("feedback_summary", with_ctes([*V.LOG, V.EXAMPLES], f"""
SELECT count(*) AS held, count(*) FILTER (provenance = 'corrected') AS corrected, count(*) FILTER (provenance = 'enriched') AS enriched,
  count(*) FILTER (provenance = 'confirmed') AS confirmed, count(*) FILTER ({_USABLE}) AS trainable,
  count(*) FILTER (rejected_only) AS rejections_without_a_label,
  round(avg(confidence_after - confidence_before), 3) AS mean_enrichment_lift FROM ex"""))
def feedback_summary(spark, sf):
    return D.feedback_summary(examples(spark, sf))


# ---------------------------------------------------------------- sampling

@query("stratified_split", with_ctes([V.VECTORS, V.SPLIT], "SELECT vec_id, category, split, fold FROM sp"))
def stratified_split(spark, sf):
    return SA.stratified_split(V.vectors(spark, sf), "category", "vec_id").select("vec_id", "category", "split", "fold")


@query("stratified_folds", """
SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) - 1) % 5 AS fold FROM documents""")
def stratified_folds(spark, sf):
    from queuemill.runtime import table
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return SA.stratified_folds(docs, "lang", "doc_id")


@query("stratified_sample", """
SELECT repeat, doc_id, lang FROM (SELECT repeat, doc_id, lang, count(*) OVER (PARTITION BY repeat, lang) AS n,
  row_number() OVER (PARTITION BY repeat, lang ORDER BY md5((42 + repeat) || '|' || doc_id), doc_id) AS rk
  FROM documents, (SELECT unnest(range(3)) AS repeat)) WHERE rk <= greatest(1, floor(n * 0.1 + 0.5))""")
def stratified_sample(spark, sf):
    from functools import reduce
    from queuemill.runtime import table
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    parts = [SA.stratified_sample(docs, "lang", "doc_id", 0.1, rep).select(
        F.lit(rep).cast("long").alias("repeat"), "doc_id", "lang") for rep in range(3)]
    return reduce(lambda a, b: a.unionByName(b), parts)
