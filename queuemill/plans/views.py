"""The given tables seen through the schemas the jobs work on, in Spark and as SQL.

Each view reads a whole table; only column expressions differ from the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuemill.functions.scalars import overridden
from queuemill.runtime import spread, table

STAMP = "yyyy-MM-dd HH:mm:ss"


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("long")


def _team(number) -> F.Column:
    return F.concat(F.lit("team_"), (number % 7).cast("string"))


# ---------------------------------------------------------------- tickets

def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    number = F.regexp_extract("source", r"(\d+)", 1).cast("long")
    return spread(table(spark, sf_dir, "documents")).select(
        d.alias("ord"),
        F.concat(F.lit("MU-"), (d + 100001).cast("string")).alias("ticket_id"),
        F.when(d % 101 == 0, "Test ticket")
        .otherwise(F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 60))
        .alias("subject"),
        F.when(d % 67 == 0, "as above").when(d % 97 == 0, "testing")
        .otherwise(F.col("text")).alias("description"),
        F.when(d % 89 == 0, "").otherwise(F.col("lang")).alias("category"),
        F.when(d % 61 == 0, "").otherwise(_team(number)).alias("team"),
        F.col("source").alias("department"),
        F.when(d % 20 < 18, "Closed").otherwise("Open").alias("status"),
        F.when(d % 8 == 0, "Yes").otherwise("No").alias("reassigned"),
        F.when(d % 71 == 0, "not a time").otherwise(F.date_format(
            F.expr("timestamp_ntz'2024-01-08 07:00:00'"
                   " + make_interval(0,0,0,0,0, CAST((n_chars * 137) % 525600 AS INT))"),
            "yyyy-MM-dd HH:mm")).alias("created"),
        F.when(d % 33 == 0, "").otherwise(
            F.concat(F.lit("Checked "), F.col("source"), F.lit(" and closed."))).alias("resolution"))


TICKETS = ("tk", """
SELECT doc_id AS ord, 'MU-' || (doc_id + 100001) AS ticket_id,
  CASE WHEN doc_id % 101 = 0 THEN 'Test ticket'
       ELSE substring(split_part(text, chr(10), 1), 1, 60) END AS subject,
  CASE WHEN doc_id % 67 = 0 THEN 'as above' WHEN doc_id % 97 = 0 THEN 'testing' ELSE text END AS description,
  CASE WHEN doc_id % 89 = 0 THEN '' ELSE lang END AS category,
  CASE WHEN doc_id % 61 = 0 THEN ''
       ELSE 'team_' || (CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) % 7) END AS team,
  source AS department,
  CASE WHEN doc_id % 20 < 18 THEN 'Closed' ELSE 'Open' END AS status,
  CASE WHEN doc_id % 8 = 0 THEN 'Yes' ELSE 'No' END AS reassigned,
  CASE WHEN doc_id % 71 = 0 THEN 'not a time' ELSE
    strftime(TIMESTAMP '2024-01-08 07:00:00' + to_minutes((n_chars * 137) % 525600), '%Y-%m-%d %H:%M') END AS created,
  CASE WHEN doc_id % 33 = 0 THEN '' ELSE 'Checked ' || source || ' and closed.' END AS resolution
FROM documents""")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relevance key; some tickets have none."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").where(d % 53 != 0).select(
        F.concat(F.lit("MU-"), (d + 100001).cast("string")).alias("ticket_id"),
        F.concat(F.lit("P"), (d % 30).cast("string")).alias("latent_problem_id"),
        F.when(d % 2 == 0, "Yes").otherwise("No").alias("had_context"),
        F.col("lang").alias("true_category"))


TRUTH = ("truth", """
SELECT 'MU-' || (doc_id + 100001) AS ticket_id, 'P' || (doc_id % 30) AS latent_problem_id,
  CASE WHEN doc_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS had_context, lang AS true_category
FROM documents WHERE doc_id % 53 <> 0""")


# ---------------------------------------------------------------- vectors

_PROBLEM = "concat('P', label, '_', vec_id % 3)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_facts(table(spark, sf_dir, "embeddings"))


def _with_facts(labelled: DataFrame, *columns: str) -> DataFrame:
    """Category, team, problem and resolution of rows (vec_id, embedding, label)."""
    letters = F.translate(F.md5(F.expr(_PROBLEM).cast("binary")), "0123456789", "ghijklmnop")
    spaced = F.trim(F.regexp_replace(letters, r"(.{4})", "$1 "))
    tail = (F.when(F.col("vec_id") % 4 == 0, ". Ticket closed.")
            .when(F.col("vec_id") % 4 == 1, ". User confirmed the issue was resolved.").otherwise("."))
    return labelled.select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"),
        F.concat(F.lit("cat_"), F.col("label")).alias("category"),
        F.concat(F.lit("team_"), F.col("label") % 7).alias("team"),
        F.expr(_PROBLEM).alias("pid"),
        F.when(F.col("vec_id") % 33 == 0, "")
        .otherwise(F.concat(F.lit("Replaced unit "), spaced, tail)).alias("resolution"), *columns)


VECTORS = ("vx", """
SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, 'cat_' || label AS category,
  'team_' || (label % 7) AS team, 'P' || label || '_' || (vec_id % 3) AS pid,
  CASE WHEN vec_id % 33 = 0 THEN '' ELSE 'Replaced unit ' ||
    trim(regexp_replace(translate(md5('P' || label || '_' || (vec_id % 3)), '0123456789', 'ghijklmnop'),
         '(.{4})', '\\1 ', 'g')) ||
    CASE vec_id % 4 WHEN 0 THEN '. Ticket closed.' WHEN 1 THEN '. User confirmed the issue was resolved.'
         ELSE '.' END END AS resolution
FROM embeddings""")

def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector and every document, joined by id: zeros stand for a vector that isn't there, NULL for a text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors_ = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    dims = vectors_.agg(F.max(F.size("embedding"))).first()[0] or 0
    both = vectors_.join(docs, F.col("vec_id") == F.col("doc_id"), "full").select(
        F.coalesce("vec_id", "doc_id").alias("vec_id"), F.coalesce("embedding", F.array_repeat(F.lit(0.0), dims)).alias("embedding"),
        F.coalesce(F.col("label").cast("long"), F.pmod("doc_id", F.lit(10))).alias("label"), "text")
    return _with_facts(both, "text")


CASES = ("vx", """
SELECT vec_id, embedding, 'cat_' || label AS category, 'team_' || (label % 7) AS team, 'P' || label || '_' || (vec_id % 3) AS pid,
  CASE WHEN vec_id % 33 = 0 THEN '' ELSE 'Replaced unit ' ||
    trim(regexp_replace(translate(md5('P' || label || '_' || (vec_id % 3)), '0123456789', 'ghijklmnop'), '(.{4})', '\\1 ', 'g')) ||
    CASE vec_id % 4 WHEN 0 THEN '. Ticket closed.' WHEN 1 THEN '. User confirmed the issue was resolved.' ELSE '.' END END AS resolution, text
FROM (SELECT coalesce(vec_id, doc_id) AS vec_id, coalesce(label, doc_id % 10) AS label, text,
        coalesce(CAST(embedding AS DOUBLE[]), list_transform(range((SELECT max(len(embedding)) FROM embeddings)), lambda x: 0::DOUBLE)) AS embedding
      FROM embeddings FULL JOIN documents ON vec_id = doc_id)""")

SPLIT = ("sp", """
SELECT *, CASE WHEN rk <= floor(0.2 * n + 0.5) THEN 'test' ELSE 'train' END AS split, (rk - 1) % 5 AS fold
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('42|' || vec_id), vec_id) AS rk,
             count(*) OVER (PARTITION BY category) AS n FROM vx)""")


# ---------------------------------------------------------------- queue events

HOLDING = ("opened", "assigned", "referred", "settled")


def ticket_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spread(table(spark, sf_dir, "events"))
    first = raw.groupBy("user_id").agg(F.min("event_id").alias("first_id"))
    k, e, kind = _k(), F.col("event_id"), F.col("event_type")
    named = (F.when(e == F.col("first_id"), "opened")
             .when(kind == "signup", "assigned").when(kind == "purchase", "referred")
             .when(kind == "click", "suggested").when(kind == "view", "enriched")
             .when(e % 3 == 0, "resolved").when(e % 3 == 1, "duplicate").otherwise("reopened"))
    duplicate_of = F.when(e % 2 == 0, F.format_string("MU-%04d", k)).otherwise(k.cast("string"))
    return (raw.join(first, "user_id").withColumn("kind", named).select(
        "event_id", F.col("user_id").alias("ticket_id"),
        F.date_format("ts", STAMP).alias("at"), "kind",
        F.concat(F.lit("agent_"), (e % 5).cast("string")).alias("actor"),
        F.when(F.col("kind").isin("opened", "assigned", "referred"), _team(k)).alias("to_team"),
        F.when(F.col("kind").isin("opened", "suggested"),
               F.concat(F.lit("cat_"), (k % 5).cast("string"))).alias("category"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"),
        F.when(F.col("kind") == "resolved", F.concat(F.lit("fix "), k.cast("string")))
        .when(F.col("kind") == "duplicate", duplicate_of).alias("detail")))


EVENTS = ("ev", """
SELECT event_id, ticket_id, "at", kind, actor,
  CASE WHEN kind IN ('opened','assigned','referred') THEN 'team_' || (k % 7) END AS to_team,
  CASE WHEN kind IN ('opened','suggested') THEN 'cat_' || (k % 5) END AS category,
  confidence,
  CASE WHEN kind = 'resolved' THEN 'fix ' || k
       WHEN kind = 'duplicate' THEN CASE WHEN event_id % 2 = 0 THEN printf('MU-%04d', k) ELSE CAST(k AS VARCHAR) END
  END AS detail
FROM (SELECT event_id, user_id AS ticket_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "at",
        CASE WHEN event_id = min(event_id) OVER (PARTITION BY user_id) THEN 'opened'
             WHEN event_type = 'signup' THEN 'assigned' WHEN event_type = 'purchase' THEN 'referred'
             WHEN event_type = 'click' THEN 'suggested' WHEN event_type = 'view' THEN 'enriched'
             WHEN event_id % 3 = 0 THEN 'resolved' WHEN event_id % 3 = 1 THEN 'duplicate'
             ELSE 'reopened' END AS kind,
        'agent_' || (event_id % 5) AS actor,
        CAST(json_extract(props, '$.k') AS BIGINT) AS k, least(value / 500, 1.0) AS confidence
      FROM events)""")

# Every event with the team that held the ticket just before it, and whether it is a real move.
MOVES = ("mv", """
SELECT *, kind = 'referred' AND (holder IS NULL OR holder <> to_team) AS is_move FROM (
  SELECT *, last_value(CASE WHEN kind IN ('opened','assigned','referred','settled') THEN to_team END IGNORE NULLS)
    OVER (PARTITION BY ticket_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS holder
  FROM ev)""")

STATE = ("st", """
SELECT g.ticket_id AS id, printf('MU-%04d', g.ticket_id) AS ref, opened_at, category, team, status,
  CASE WHEN closing_kind IN ('resolved','duplicate') THEN closing_at END AS closed_at, resolution,
  CASE WHEN regexp_matches(trim(dup), '^[0-9]+$') THEN CAST(trim(dup) AS BIGINT) ELSE t.ticket_id END AS duplicate_of,
  hops, last_event_id
FROM (SELECT ticket_id,
    arg_min("at", event_id) FILTER (kind = 'opened') AS opened_at,
    arg_max(category, event_id) FILTER (kind IN ('opened','settled') AND category IS NOT NULL) AS category,
    arg_max(to_team, event_id) FILTER (kind IN ('opened','assigned','referred','settled') AND to_team IS NOT NULL) AS team,
    arg_max(CASE kind WHEN 'resolved' THEN 'resolved' WHEN 'duplicate' THEN 'duplicate'
                 WHEN 'referred' THEN 'referred' ELSE 'open' END, event_id)
      FILTER (kind IN ('opened','resolved','duplicate','reopened') OR is_move) AS status,
    arg_max(kind, event_id) FILTER (kind IN ('resolved','duplicate','reopened')) AS closing_kind,
    arg_max("at", event_id) FILTER (kind IN ('resolved','duplicate','reopened')) AS closing_at,
    arg_max(detail, event_id) FILTER (kind = 'resolved') AS resolution,
    arg_max(detail, event_id) FILTER (kind = 'duplicate') AS dup,
    CAST(count(*) FILTER (is_move) AS BIGINT) AS hops, max(event_id) AS last_event_id
  FROM mv GROUP BY ticket_id) g
LEFT JOIN (SELECT DISTINCT ticket_id FROM ev) t ON printf('MU-%04d', t.ticket_id) = g.dup""")

QUEUE = [EVENTS, MOVES, STATE]


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of queue commands; some name unknown tickets, no team or an unknown action."""
    k, e, kind = _k(), F.col("event_id"), F.col("event_type")
    action = (F.when(kind == "purchase", "refer").when(kind == "signup", "assign")
              .when(kind == "click", "note").when(kind == "view", "escalate")
              .when(e % 3 == 0, "resolve").when(e % 3 == 1, "duplicate").otherwise("reopen"))
    return spread(table(spark, sf_dir, "events")).select(
        e.alias("command_id"), F.date_format("ts", STAMP).alias("at"),
        F.when(e % 13 == 0, "MU-9999999").when(e % 2 == 0, F.col("user_id").cast("string"))
        .otherwise(F.format_string("MU-%04d", "user_id")).alias("ref"),
        action.alias("action"),
        F.when(e % 11 == 0, "").otherwise(_team(k + 1)).alias("team"),
        F.concat(F.lit("agent_"), (e % 5).cast("string")).alias("actor"),
        # Absent, empty and very long texts among them.
        F.when(e % 12 == 3, "").when(e % 36 == 9, F.repeat(F.concat(F.lit("note "), k.cast("string"), F.lit("; ")), 400))
        .when(e % 4 != 0, F.concat(F.lit("note "), k.cast("string"))).alias("detail"),
        F.format_string("MU-%04d", k).alias("of"))


COMMANDS = ("cm", """
SELECT event_id AS command_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "at",
  CASE WHEN event_id % 13 = 0 THEN 'MU-9999999' WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR)
       ELSE printf('MU-%04d', user_id) END AS ref,
  CASE WHEN event_type = 'purchase' THEN 'refer' WHEN event_type = 'signup' THEN 'assign'
       WHEN event_type = 'click' THEN 'note' WHEN event_type = 'view' THEN 'escalate'
       WHEN event_id % 3 = 0 THEN 'resolve' WHEN event_id % 3 = 1 THEN 'duplicate' ELSE 'reopen' END AS action,
  CASE WHEN event_id % 11 = 0 THEN '' ELSE 'team_' || ((CAST(json_extract(props, '$.k') AS BIGINT) + 1) % 7) END AS team,
  'agent_' || (event_id % 5) AS actor,
  CASE WHEN event_id % 12 = 3 THEN '' WHEN event_id % 36 = 9 THEN repeat('note ' || CAST(json_extract(props, '$.k') AS BIGINT) || '; ', 400)
       WHEN event_id % 4 <> 0 THEN 'note ' || CAST(json_extract(props, '$.k') AS BIGINT) END AS detail,
  printf('MU-%04d', CAST(json_extract(props, '$.k') AS BIGINT)) AS "of"
FROM events""")


# ---------------------------------------------------------------- decisions

def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision entries as they arrive, before validation."""
    k, e, kind = _k(), F.col("event_id"), F.col("event_type")
    number = F.element_at(F.create_map(*[F.lit(x) for pair in (
        ("click", 0), ("error", 1), ("purchase", 2), ("signup", 3), ("view", 4)) for x in pair]), kind)
    before = F.least(F.col("value") / 500, F.lit(1.0)) / 2
    follow = lambda value, step: F.when(e % 5 == 0, step).when(e % 5 != 1, value)
    words = F.concat(F.lit("printer on floor "), k.cast("string"), F.lit(" shows an error"))
    return spread(table(spark, sf_dir, "events")).select(
        e.alias("decision_id"), F.date_format("ts", STAMP).alias("at"),
        F.when(e % 2 == 0, "A").otherwise("B").alias("arm"),
        F.when(e % 7 != 0, F.format_string("MU-%04d", "user_id")).alias("db_ref"),
        F.concat(F.lit("agent_"), (e % 5).cast("string")).alias("actor"),
        F.concat(F.lit("ticket "), F.col("user_id").cast("string")).alias("subject"),
        F.when(e % 17 == 0, "").otherwise(F.repeat(words, F.lit(1) + (e % 40).cast("int"))).alias("description"),
        F.concat(F.lit("cat_"), number.cast("string")).alias("suggested_category"),
        follow(F.concat(F.lit("cat_"), number.cast("string")),
               F.concat(F.lit("cat_"), ((number + 1) % 5).cast("string"))).alias("chosen_category"),
        _team(k).alias("suggested_team"),
        follow(_team(k), _team(k + 1)).alias("chosen_team"),
        F.when(e % 9 == 0, F.concat(F.lit("note "), k.cast("string"))).otherwise("").alias("resolution_used"),
        F.when(e % 10 == 3, F.format_string("MU-%04d", k)).alias("resolved_with"),
        F.when((kind == "purchase") & (e % 3 == 0), _team(k + 1)).alias("referred_to"),
        F.when(e % 16 == 5, F.format_string("MU-%04d", k)).alias("closed_as_duplicate_of"),
        F.when(e % 6 == 0, True).alias("abstained"),
        (kind == "error").alias("rejected"), (kind == "view").alias("enriched"),
        F.when(e % 23 == 0, "no text").alias("text_before"),
        F.when(e % 2 == 0, "too short").otherwise(F.repeat(F.concat(words, F.lit("; ")), F.lit(12))).alias("text_after"),
        before.alias("confidence_before"),
        F.when(e % 11 != 0, before + F.lit(0.1) * (e % 4)).alias("confidence_after"),
        (before + F.lit(0.1)).alias("confidence_category"), (before + F.lit(0.2)).alias("confidence_team"))


_NUM = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"
ENTRIES = ("en", f"""
SELECT event_id AS decision_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "at",
  CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS arm,
  CASE WHEN event_id % 7 <> 0 THEN printf('MU-%04d', user_id) END AS db_ref,
  'agent_' || (event_id % 5) AS actor, 'ticket ' || user_id AS subject,
  CASE WHEN event_id % 17 = 0 THEN '' ELSE repeat('printer on floor ' || k || ' shows an error', 1 + event_id % 40) END AS description,
  'cat_' || num AS suggested_category,
  CASE WHEN event_id % 5 = 0 THEN 'cat_' || ((num + 1) % 5) WHEN event_id % 5 <> 1 THEN 'cat_' || num END AS chosen_category,
  'team_' || (k % 7) AS suggested_team,
  CASE WHEN event_id % 5 = 0 THEN 'team_' || ((k + 1) % 7) WHEN event_id % 5 <> 1 THEN 'team_' || (k % 7) END AS chosen_team,
  CASE WHEN event_id % 9 = 0 THEN 'note ' || k ELSE '' END AS resolution_used,
  CASE WHEN event_id % 10 = 3 THEN printf('MU-%04d', k) END AS resolved_with,
  CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'team_' || ((k + 1) % 7) END AS referred_to,
  CASE WHEN event_id % 16 = 5 THEN printf('MU-%04d', k) END AS closed_as_duplicate_of,
  CASE WHEN event_id % 6 = 0 THEN true END AS abstained,
  event_type = 'error' AS rejected, event_type = 'view' AS enriched,
  CASE WHEN event_id % 23 = 0 THEN 'no text' END AS text_before,
  CASE WHEN event_id % 2 = 0 THEN 'too short' ELSE repeat('printer on floor ' || k || ' shows an error; ', 12) END AS text_after,
  before AS confidence_before,
  CASE WHEN event_id % 11 <> 0 THEN before + 0.1::DOUBLE * (event_id % 4) END AS confidence_after,
  before + 0.1::DOUBLE AS confidence_category, before + 0.2::DOUBLE AS confidence_team
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, {_NUM} AS num,
        least(value / 500, 1.0) / 2 AS before FROM events)""")

_DIFFER = "coalesce(chosen_{0} <> '' AND suggested_{0} <> '' AND chosen_{0} <> suggested_{0}, false)"
DECISIONS = ("dc", f"""
SELECT * REPLACE (substring(coalesce(subject,''),1,300) AS subject, substring(coalesce(description,''),1,1000) AS description,
    substring(coalesce(text_before,''),1,600) AS text_before, substring(coalesce(text_after,''),1,600) AS text_after,
    coalesce(abstained,false) AS abstained, coalesce(rejected,false) AS rejected, coalesce(enriched,false) AS enriched),
  {_DIFFER.format('category')} AS category_overridden, {_DIFFER.format('team')} AS team_overridden
FROM en""")

LOG = [ENTRIES, DECISIONS]

EXAMPLES = ("ex", """
SELECT "at", arm, subject, description, coalesce(chosen_category,'') AS category, coalesce(chosen_team,'') AS assigned_team,
  provenance, rejected AND NOT coalesce(chosen_team <> '', false) AS rejected_only, confidence_before, confidence_after, text
FROM (SELECT *, CASE WHEN enriched THEN 'enriched'
        WHEN rejected OR coalesce(referred_to <> '', false) OR category_overridden OR team_overridden THEN 'corrected'
        WHEN coalesce(chosen_category <> '', false) OR coalesce(chosen_team <> '', false) THEN 'confirmed' END AS provenance,
        trim(CASE WHEN text_after <> '' THEN text_after ELSE subject || ' ' || description END) AS text FROM dc)
WHERE provenance IS NOT NULL AND len(string_split_regex(text, '\\s+')) >= 3""")
