"""Queries that go through storage or a stream, each with its check."""

import uuid

from pyspark.sql import functions as F

from queuemill import fixed
from queuemill.operators import decisions as D
from queuemill.operators import lifecycle as L
from queuemill.operators import votes as VO
from queuemill.plans import decision_queries as DQ
from queuemill.plans import lifecycle_queries as LQ
from queuemill.plans import score_queries as SQ
from queuemill.plans import views as V
from queuemill.plans.registry import query, with_ctes
from queuemill.runtime import fresh_path, rounded, table
from queuemill.sources import io as IO
from queuemill.streaming import jobs as J

FILES = 4


@query("scan_corpus_csv", with_ctes([V.TICKETS], """
SELECT ticket_id, subject, description, category, department, team, status, resolution, created, reassigned FROM tk"""))
def scan_corpus_csv(spark, sf):
    path = fresh_path(spark, "export")
    back = {v: k for k, v in IO.EXPORT_COLUMNS.items()}
    tickets = V.tickets(spark, sf).withColumns({c: F.lit(None).cast("string") for c in ("subcategory", "resolver", "resolved")})
    IO.write_corpus_csv(tickets.select(*[F.col(c).alias(back[c]) for c in IO.EXPORT_COLUMNS.values()]), path)
    scanned = IO.scan_corpus_csv(spark, path).withColumnsRenamed(IO.EXPORT_COLUMNS)
    return scanned.select("ticket_id", "subject", "description", "category", "department", "team", "status", "resolution", "created", "reassigned")


_LOGGED = """SELECT decision_id, arm, subject, chosen_team, referred_to, rejected, team_overridden, round(confidence_before, 6) AS confidence_before FROM {}"""


def _logged(df):
    return df.select("decision_id", "arm", "subject", "chosen_team", "referred_to", "rejected", "team_overridden",
                     rounded(F.col("confidence_before")).alias("confidence_before"))


def logged_decisions(spark, sf, files=FILES):
    """The log on disk, in arrival order over several files, with a broken and a blank line added."""
    path = fresh_path(spark, "decisions")
    spread = V.entries(spark, sf).repartitionByRange(files, "decision_id")
    IO.append_decision_log(spread, path)
    broken = spark.range(2).select(F.when(F.col("id") == 0, '{"decision_id": 1, "arm').otherwise("").alias("value"))
    broken.write.mode("append").text(path)
    return path


@query("scan_decision_log", with_ctes(V.LOG, _LOGGED.format("dc")))
def scan_decision_log(spark, sf):
    return _logged(IO.scan_decision_log(spark, logged_decisions(spark, sf)))


@query("append_decision_log", with_ctes(V.LOG, "SELECT arm, count(*) AS n, count(*) FILTER (team_overridden) AS over FROM dc GROUP BY arm"))
def append_decision_log(spark, sf):
    path = fresh_path(spark, "decisions")
    for arm in ("A", "B"):
        IO.append_decision_log(V.entries(spark, sf).where(F.col("arm") == arm), path)
    return IO.scan_decision_log(spark, path).groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("team_overridden").alias("over"))


@query("append_feedback", with_ctes([*V.LOG, V.EXAMPLES], DQ._EX.format("ex")))
def append_feedback(spark, sf):
    path = fresh_path(spark, "feedback")
    IO.append_feedback(DQ.held(spark, sf), path)
    IO.append_feedback(DQ.examples(spark, sf), path)
    return DQ._shown(IO.scan_feedback(spark, path))


@query("write_result_table", with_ctes(V.QUEUE, LQ.TEAM_REPORT))
def write_result_table(spark, sf):
    path = fresh_path(spark, "report")
    report = L.team_workload(V.ticket_events(spark, sf))
    IO.write_result_table(report, path)
    return spark.read.schema(report.schema).option("header", "true").csv(path)


@query("publish_predictions", with_ctes([V.VECTORS, SQ.SCORES], "SELECT model, count(*) AS n, round(sum(score), 4) AS total FROM fs GROUP BY model"))
def publish_predictions(spark, sf):
    path = fresh_path(spark, "predictions")
    # Two models one after the other, the first one again, and then all others: none may replace another.
    for part in ("model = 'm0'", "model = 'm1'", "model = 'm0'", "model NOT IN ('m0', 'm1')"):
        IO.publish_predictions(SQ.scores(spark, sf).where(part), path)
    return spark.read.parquet(path).groupBy("model").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("score"), 4).alias("total"))


@query("read_predictions", with_ctes([V.VECTORS, SQ.SCORES], "SELECT ticket_id, class, round(score, 6) AS score FROM fs WHERE model = 'm3'"))
def read_predictions(spark, sf):
    path = fresh_path(spark, "predictions")
    IO.publish_predictions(SQ.scores(spark, sf), path)
    return IO.read_predictions(spark, path, "scores", "m3").select("ticket_id", "class", rounded(F.col("score")).alias("score"))


@query("export_findings_json", with_ctes([*V.QUEUE, ("tr", LQ.TEAM_REPORT), *V.LOG], """
SELECT '{"overrides":[' || (SELECT string_agg(printf('{"from_team":"%s","to_team":"%s","n":%d}', from_team, to_team, n), ',' ORDER BY from_team, to_team) FROM (
  SELECT suggested_team AS from_team, chosen_team AS to_team, count(*) AS n FROM dc WHERE chosen_team <> '' AND team_overridden GROUP BY ALL ORDER BY n DESC, from_team, to_team LIMIT 5))
|| '],"workload":[' || (SELECT string_agg(printf('{"team":"%s","total":%d,"open":%d,"resolved":%d,"inherited":%d,"passed_on":%d}', team, total, "open", resolved, inherited, passed_on), ',' ORDER BY team) FROM tr) || ']}' AS document"""))
def export_findings_json(spark, sf):
    moves = L.with_holder(V.ticket_events(spark, sf))
    return IO.export_findings_json({
        "workload": L.team_report(L.fold(moves), moves).select("team", *L.EMPTY_TEAM),
        "overrides": D.override_flows(DQ.decisions(spark, sf))})


@query("event_tables", with_ctes([V.EVENTS], 'SELECT event_id, ticket_id, "at", kind, actor, to_team, category, round(confidence, 6) AS confidence, detail FROM ev'))
def event_tables(spark, sf):
    path = fresh_path(spark, "events")
    IO.append_events(V.ticket_events(spark, sf), path, buckets=8)
    return IO.read_events(spark, path).select("event_id", "ticket_id", "at", "kind", "actor", "to_team", "category",
                                              rounded(F.col("confidence")).alias("confidence"), "detail")


@query("event_table_state", with_ctes(V.QUEUE, "SELECT * FROM st"))
def event_table_state(spark, sf):
    """Written in two deliveries, compacted, and folded bucket by bucket."""
    names = [f"events_{uuid.uuid4().hex}" for _ in range(2)]
    IO.create_event_table(spark, names[0], fresh_path(spark, "event-table"), 8)
    for part in deliveries(V.ticket_events(spark, sf), "event_id"):
        IO.append_event_table(part, names[0])
    IO.compact_event_table(spark, *names, fresh_path(spark, "event-table"), 8)
    return L.state_of_buckets(spark.table(names[1]))


# ---------------------------------------------------------------- intake

ARRIVALS = [V.VECTORS, SQ.SCORES, SQ.NORM, ("sb", SQ.best_sql("(SELECT * FROM ns WHERE model = 'm0')")), ("it", """
SELECT vec_id AS ord, 101 + vec_id AS id, predicted AS category, round(round(confidence, 9), 4) AS confidence, 'team_' || (substring(predicted, 5)::BIGINT % 7) AS proposed,
  coalesce(round(round(confidence, 9), 4) < 0.2, false) AS abstained
FROM (SELECT vec_id FROM vx) LEFT JOIN (SELECT * FROM sb WHERE ticket_id % 19 <> 0) ON ticket_id = vec_id""")]
INTAKE = with_ctes(ARRIVALS, f"""
SELECT id * 2 - 202 + n AS event_id, id AS ticket_id, kind, CASE WHEN abstained THEN '{fixed.FIRST_LINE}' ELSE proposed END AS to_team, category, confidence,
  CASE WHEN n = 1 AND abstained THEN 'abstained at ' || confidence || ' -- would have said ' || proposed || '; sent to the first line instead' END AS detail
FROM it, (VALUES (0, 'opened'), (1, 'suggested')) s(n, kind)""")


def arrivals(spark, sf):
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        v.alias("ord"), F.lit("2024-07-01 08:00:00").alias("at"), F.concat(F.lit("Request "), v.cast("string")).alias("subject"),
        F.lit("").alias("description"), F.lit("").alias("requester"))


def triage(spark, sf):
    """Suggestions for most arrivals; the rest stay without one."""
    normal = VO.normalised(SQ.scores(spark, sf).where("model = 'm0' AND ticket_id % 19 <> 0"), [*SQ.KEYS, "model"])
    best = VO.argmax_class(normal, ["ticket_id"])
    return best.select(F.col("ticket_id").alias("ord"), F.col("predicted").alias("category"), rounded(rounded(F.col("confidence"), 9), 4).alias("confidence"),
                       F.concat(F.lit("team_"), (F.substring("predicted", 5, 9).cast("long") % 7).cast("string")).alias("team"))


def _events_shown(events):
    return events.select("event_id", "ticket_id", "kind", "to_team", "category", "confidence", "detail")


@query("intake", INTAKE)
def intake(spark, sf):
    _, events = L.intake(arrivals(spark, sf), triage(spark, sf), 100, 0, 0.2)
    return _events_shown(events)


# ---------------------------------------------------------------- streams

@query("stream_decision_summary", with_ctes(V.LOG, DQ.SUMMARY))
def stream_decision_summary(spark, sf):
    path, out = logged_decisions(spark, sf), fresh_path(spark, "summary")
    stream = J.read_stream(spark, path, IO.DECISION_SCHEMA, files_per_batch=2)
    J.stream_decision_summary(stream, out, fresh_path(spark, "checkpoint")).awaitTermination()
    return J.latest_batch(spark, out)


@query("stream_ticket_state", with_ctes(V.QUEUE, "SELECT id AS ticket_id, team, status, category, closed_at, resolution, hops, last_event_id FROM st"))
def stream_ticket_state(spark, sf):
    path, log, checkpoint = (fresh_path(spark, t) for t in ("events", "state", "checkpoint"))
    events = V.ticket_events(spark, sf)
    for part in late_deliveries(events, "event_id"):
        part.write.mode("append").parquet(path)
        # The stream is stopped after each delivery and goes on from its checkpoint.
        stream = J.read_stream(spark, path, events.schema, "parquet")
        J.stream_ticket_state(stream, log, checkpoint).awaitTermination()
    return J.latest_state(J.state_log(spark, f"{log}/state")).select("ticket_id", "team", "status", "category", "closed_at", "resolution", "hops", "last_event_id")


@query("stream_intake", INTAKE)
def stream_intake(spark, sf):
    path, opened, events, checkpoint = (fresh_path(spark, t) for t in ("arrivals", "opened", "intake-events", "checkpoint"))
    incoming, scored = arrivals(spark, sf), triage(spark, sf)
    for part in deliveries(incoming, "ord"):
        part.write.mode("append").parquet(path)
        stream = J.read_stream(spark, path, incoming.schema, "parquet")
        J.stream_intake(stream, lambda batch: scored, opened, events, checkpoint, 100, 0, 0.2).awaitTermination()
    return _events_shown(spark.read.parquet(events))


def deliveries(df, order):
    """The whole table in two parts, one after the other."""
    middle = df.agg(F.percentile_approx(order, F.lit(0.5))).first()[0]
    return df.where(F.col(order) <= middle), df.where(F.col(order) > middle)


def late_deliveries(df, order):
    """The whole table in two parts that are mixed in order, so that many events come late."""
    late = F.pmod(F.xxhash64(order), F.lit(5)) == 0
    return df.where(~late), df.where(late)
