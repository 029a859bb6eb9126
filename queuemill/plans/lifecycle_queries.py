"""Queries over the ticket queue, each with its check."""

from pyspark.sql import functions as F

from queuemill.functions import scalars as S
from queuemill.operators import lifecycle as L
from queuemill.plans import views as V
from queuemill.plans.registry import query, with_ctes
from queuemill.runtime import rounded

TEAM_REPORT = """
SELECT team, CAST(sum(total) AS BIGINT) AS total, CAST(sum("open") AS BIGINT) AS "open",
  CAST(sum(resolved) AS BIGINT) AS resolved, CAST(sum(inherited) AS BIGINT) AS inherited,
  CAST(sum(passed_on) AS BIGINT) AS passed_on FROM (
  SELECT team, count(*) AS total, count(*) FILTER (status IN ('open','referred')) AS "open",
    count(*) FILTER (status = 'resolved') AS resolved, 0 AS inherited, 0 AS passed_on
  FROM st WHERE team IS NOT NULL GROUP BY team
  UNION ALL SELECT to_team, 0, 0, 0, count(*), 0 FROM mv WHERE is_move GROUP BY to_team
  UNION ALL SELECT holder, 0, 0, 0, 0, count(*) FROM mv WHERE is_move AND holder IS NOT NULL GROUP BY holder)
GROUP BY team"""


def _events(spark, sf):
    return V.ticket_events(spark, sf)


def _state(spark, sf):
    return L.current_state(_events(spark, sf))


def _moves(spark, sf):
    return L.with_holder(_events(spark, sf))


@query("team_workload", with_ctes(V.QUEUE, TEAM_REPORT))
def team_workload(spark, sf):
    return L.team_workload(_events(spark, sf))


@query("team_report_outer", with_ctes(V.QUEUE, TEAM_REPORT))
def team_report_outer(spark, sf):
    moves = _moves(spark, sf)
    return L.team_report(L.fold(moves), moves)


@query("workload_sort", with_ctes(V.QUEUE, f"""
SELECT *, row_number() OVER (ORDER BY "open" DESC, total DESC, team) AS place FROM ({TEAM_REPORT})"""))
def workload_sort(spark, sf):
    from pyspark.sql import Window as W
    # One row per team: the report is already reduced when its places are numbered.
    place = F.row_number().over(W.orderBy(F.desc("open"), F.desc("total"), "team")).cast("long")
    moves = _moves(spark, sf)
    return L.sort_workload(L.team_report(L.fold(moves), moves)).withColumn("place", place)


@query("as_of_holder", with_ctes([V.EVENTS, V.MOVES],
       "SELECT event_id, ticket_id, kind, to_team, holder FROM mv"))
def as_of_holder(spark, sf):
    return _moves(spark, sf).select("event_id", "ticket_id", "kind", "to_team", "holder")


@query("hop_count", with_ctes([V.EVENTS, V.MOVES],
       "SELECT ticket_id, CAST(count(*) FILTER (is_move) AS BIGINT) AS hops FROM mv GROUP BY ticket_id"))
def hop_count(spark, sf):
    return _moves(spark, sf).groupBy("ticket_id").agg(F.count_if("is_move").alias("hops"))


@query("current_state", with_ctes(V.QUEUE, "SELECT * FROM st"))
def current_state(spark, sf):
    return _state(spark, sf)


@query("duplicate_link", with_ctes(V.QUEUE, "SELECT ref, duplicate_of FROM st WHERE duplicate_of IS NOT NULL"))
def duplicate_link(spark, sf):
    return _state(spark, sf).where("duplicate_of is not null").select("ref", "duplicate_of")


@query("handoffs", with_ctes([V.EVENTS, V.MOVES], """
SELECT holder AS from_team, to_team, count(*) AS n FROM mv WHERE is_move AND holder IS NOT NULL
GROUP BY ALL ORDER BY n DESC, from_team, to_team LIMIT 10"""))
def handoffs(spark, sf):
    return L.handoffs(_moves(spark, sf))


STATS = """
SELECT count(*) AS total, count(*) FILTER (status IN ('open','referred')) AS "open",
  count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'duplicate') AS duplicate,
  count(*) FILTER (hops > 0) AS ever_referred, count(DISTINCT team) AS teams,
  round(CAST(count(*) FILTER (hops > 0) AS DOUBLE) / count(*), 3) AS reassignment_rate FROM st"""


@query("queue_stats", with_ctes(V.QUEUE, STATS))
def queue_stats(spark, sf):
    return L.queue_stats(_state(spark, sf))


@query("reassigned_share", with_ctes([*V.QUEUE, V.TICKETS], f"""
SELECT *, CASE WHEN live_rate > corpus_rate THEN 'above' WHEN live_rate < corpus_rate THEN 'below'
  ELSE 'level with' END AS direction
FROM (SELECT round(avg(CASE WHEN reassigned = 'Yes' THEN 1.0 ELSE 0.0 END), 3) AS corpus_rate FROM tk),
     (SELECT reassignment_rate AS live_rate FROM ({STATS}))"""))
def reassigned_share(spark, sf):
    return L.reassigned_share(V.tickets(spark, sf), L.queue_stats(_state(spark, sf)))


@query("queue_page", with_ctes(V.QUEUE, "SELECT id, ref, status, team, hops FROM st ORDER BY id DESC LIMIT 100"))
def queue_page(spark, sf):
    return L.queue(_state(spark, sf)).select("id", "ref", "status", "team", "hops")


@query("queue_filter", with_ctes(V.QUEUE, """
SELECT id, ref, status, team, hops FROM st WHERE status = 'referred' AND team = 'team_1' ORDER BY id DESC LIMIT 100"""))
def queue_filter(spark, sf):
    return L.queue(_state(spark, sf), "referred", "team_1").select("id", "ref", "status", "team", "hops")


@query("journey", with_ctes(V.QUEUE, """
SELECT mv.event_id, mv.ticket_id, mv.kind, CASE WHEN is_move THEN holder END AS from_team, mv.to_team, mv.detail,
  st.status AS ticket_status, st.team AS ticket_team, st.hops AS ticket_hops
FROM mv JOIN st ON st.id = mv.ticket_id"""))
def journey(spark, sf):
    return L.journey(_events(spark, sf)).select(
        "event_id", "ticket_id", "kind", "from_team", "to_team", "detail", "ticket_status", "ticket_team", "ticket_hops")


@query("all_teams", with_ctes(V.QUEUE, """
SELECT DISTINCT team FROM (SELECT team FROM st UNION ALL SELECT to_team FROM ev) WHERE team IS NOT NULL"""))
def all_teams(spark, sf):
    events = _events(spark, sf)
    return L.all_teams(L.current_state(events), events)


@query("known_teams", with_ctes([*V.QUEUE, V.TICKETS], """
SELECT DISTINCT team FROM (SELECT team FROM st UNION ALL SELECT to_team FROM ev UNION ALL SELECT team FROM tk)
WHERE team IS NOT NULL AND team <> ''"""))
def known_teams(spark, sf):
    events = _events(spark, sf)
    return L.known_teams(L.all_teams(L.current_state(events), events), V.tickets(spark, sf))


@query("ticket_ref", "SELECT event_id, printf('MU-%04d', user_id) AS ref FROM events")
def ticket_ref(spark, sf):
    return _events(spark, sf).select("event_id", S.ticket_ref(F.col("ticket_id")).alias("ref"))


@query("resolve_ref", with_ctes([V.EVENTS, V.COMMANDS], """
SELECT command_id, cm.ref, t.ticket_id FROM cm LEFT JOIN (SELECT DISTINCT ticket_id FROM ev) t
  ON printf('MU-%04d', t.ticket_id) = cm.ref OR CAST(t.ticket_id AS VARCHAR) = cm.ref"""))
def resolve_ref(spark, sf):
    known = _events(spark, sf).select(F.col("ticket_id").alias("id")).distinct()
    return L.resolve_refs(V.commands(spark, sf), known).select("command_id", "ref", "ticket_id")


@query("open_tickets", with_ctes([V.TICKETS, V.EVENTS], """
SELECT ord, id, printf('MU-%04d', id) AS ref, substring(subject, 1, 300) AS subject,
  substring(description, 1, 2000) AS description, 'open' AS status, CAST(0 AS BIGINT) AS hops
FROM (SELECT *, (SELECT max(ticket_id) FROM ev) + row_number() OVER (ORDER BY ord) AS id FROM tk)"""))
def open_tickets(spark, sf):
    opened = L.open_tickets(V.tickets(spark, sf), L.max_id(_events(spark, sf)))
    return opened.select("ord", "id", "ref", "subject", "description", "status", "hops")


ALL_ACTIONS = (*L.QUEUE_ACTIONS, "note")
CHECKED = """
SELECT cm.*, t.ticket_id, CASE WHEN t.ticket_id IS NULL THEN 'no such ticket'
    WHEN action = 'refer' AND trim(team) = '' THEN 'Choose a team to refer to.'
    WHEN action = 'assign' AND trim(team) = '' THEN 'Choose a team.'
    WHEN action NOT IN ('refer','resolve','reopen','assign','duplicate'__NOTE__) THEN 'unknown action: ' || action END AS error
FROM cm LEFT JOIN (SELECT DISTINCT ticket_id FROM ev) t
  ON printf('MU-%04d', t.ticket_id) = cm.ref OR CAST(t.ticket_id AS VARCHAR) = cm.ref"""

APPENDED = """
SELECT event_id, ticket_id, kind, actor, to_team, detail, CASE WHEN kind IN ('referred','assigned') THEN holder END AS from_team
FROM (SELECT *, last_value(CASE WHEN kind IN ('opened','assigned','referred','settled') THEN to_team END IGNORE NULLS)
    OVER (PARTITION BY ticket_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS holder
  FROM (SELECT event_id, ticket_id, kind, actor, to_team, detail, 0 AS fresh FROM ev UNION ALL SELECT *, 1 FROM nw))
WHERE fresh = 1 AND (kind <> 'referred' OR holder IS NULL OR holder <> to_team)"""


def _command_ctes(action):
    narrowed = f"SELECT * FROM ({V.COMMANDS[1]}) WHERE action = '{action}'" if action else V.COMMANDS[1]
    # A note is appended by services; the queue itself doesn't take it as an action.
    return [V.EVENTS, ("cm", narrowed), ("ck", CHECKED.replace("__NOTE__", ",'note'" if action == "note" else "")), ("nw", """
SELECT (SELECT max(event_id) FROM ev) + 1 + command_id AS event_id, ticket_id,
  CASE action WHEN 'refer' THEN 'referred' WHEN 'resolve' THEN 'resolved' WHEN 'reopen' THEN 'reopened'
    WHEN 'assign' THEN 'assigned' WHEN 'duplicate' THEN 'duplicate' ELSE 'enriched' END AS kind, actor,
  CASE WHEN action IN ('refer','assign') THEN trim(team) END AS to_team,
  CASE action WHEN 'duplicate' THEN "of" WHEN 'resolve' THEN substring(coalesce(detail, ''), 1, 500) WHEN 'assign' THEN NULL ELSE detail END AS detail
FROM ck WHERE error IS NULL""")]


def _command_query(name, action):
    def run(spark, sf):
        events = _events(spark, sf)
        known = events.select(F.col("ticket_id").alias("id")).distinct()
        batch = V.commands(spark, sf).where(F.col("action") == action)
        allowed = ALL_ACTIONS if action == "note" else L.QUEUE_ACTIONS
        kept = ["resolution"] if action == "resolve" else []
        return L.command_events(batch, known, events, allowed).select(
            "event_id", "ticket_id", "kind", "actor", "to_team", "detail", "from_team", *kept)
    sql = APPENDED if action != "resolve" else f"""
SELECT ap.*, nullif(substring(ck.detail, 1, 2000), '') AS resolution FROM ({APPENDED}) ap
JOIN ck ON ap.event_id = (SELECT max(event_id) FROM ev) + 1 + ck.command_id"""
    query(name, with_ctes(_command_ctes(action), sql))(run)


for _name, _action in (("refer", "refer"), ("resolve", "resolve"), ("mark_duplicate", "duplicate"),
                       ("reopen", "reopen"), ("assign", "assign"), ("note", "note")):
    _command_query(_name, _action)


@query("ticket_actions", with_ctes([*_command_ctes(None), ("ap", APPENDED)], """
SELECT ck.command_id, ck.action, ck.ticket_id, ck.error, ap.event_id, ap.from_team, ap.to_team
FROM ck LEFT JOIN ap ON ap.event_id = (SELECT max(event_id) FROM ev) + 1 + ck.command_id"""))
def ticket_actions(spark, sf):
    events = _events(spark, sf)
    known = events.select(F.col("ticket_id").alias("id")).distinct()
    batch = V.commands(spark, sf)
    base = L.max_event_id(events) + 1
    added = L.command_events(batch, known, events).select(
        (F.col("event_id") - base).alias("command_id"), "event_id", "from_team", "to_team")
    return (L.checked_commands(batch, known).select("command_id", "action", "ticket_id", "error")
            .join(added, "command_id", "left"))


DECISION_STEPS = """
SELECT (SELECT max(event_id) FROM ev) + 1 + decision_id * 8 + step AS event_id, ticket_id, kind, actor, to_team, detail, category, confidence, suggested_team FROM (
  SELECT *, 0 AS step, 'opened' AS kind, team AS to_team, cat AS category, confidence_team AS confidence, NULL AS detail FROM dm WHERE is_new
  UNION ALL SELECT *, 0, 'settled', team, cat, NULL, NULL FROM dm WHERE NOT is_new AND (cat IS NOT NULL OR team IS NOT NULL)
  UNION ALL SELECT *, 1, 'rejected', NULL, suggested_category, confidence_team, NULL FROM dm WHERE rejected
  UNION ALL SELECT *, 2, 'enriched', NULL, NULL, confidence_after, substring(text_after, 1, 500) FROM dm WHERE enriched
  UNION ALL SELECT *, 3, CASE WHEN rejected THEN 'corrected' ELSE 'accepted' END, chosen_team, cat, NULL, NULL
    FROM dm WHERE category_overridden OR team_overridden
  UNION ALL SELECT *, 4, 'referred', referred_to, NULL, NULL, 'referred from the queue' FROM dm WHERE referred_to <> ''
  UNION ALL SELECT *, 4, 'duplicate', NULL, NULL, NULL, closed_as_duplicate_of FROM dm
    WHERE coalesce(referred_to, '') = '' AND closed_as_duplicate_of <> ''
  UNION ALL SELECT *, 4, 'resolved', NULL, NULL, NULL, 'reused the fix from ' || resolved_with FROM dm
    WHERE coalesce(referred_to, '') = '' AND coalesce(closed_as_duplicate_of, '') = '' AND resolved_with <> '')"""


@query("apply_decisions", with_ctes([V.EVENTS, *V.LOG, ("dm", """
SELECT * REPLACE (coalesce(ticket_id, (SELECT max(ticket_id) FROM ev) + nr) AS ticket_id) FROM (
  SELECT dc.* REPLACE (coalesce(nullif(actor, ''), 'resolver') AS actor), t.ticket_id, t.ticket_id IS NULL AS is_new,
    row_number() OVER (PARTITION BY t.ticket_id IS NULL ORDER BY decision_id) AS nr,
    coalesce(nullif(chosen_category, ''), nullif(suggested_category, '')) AS cat,
    coalesce(nullif(chosen_team, ''), nullif(suggested_team, '')) AS team
  FROM dc LEFT JOIN (SELECT DISTINCT ticket_id FROM ev) t ON printf('MU-%04d', t.ticket_id) = dc.db_ref)"""),
    ("ns", DECISION_STEPS), ("nw", "SELECT event_id, ticket_id, kind, actor, to_team, detail FROM ns"), ("ap", APPENDED)], """
SELECT ap.event_id, ap.ticket_id, ap.kind, ap.actor, ap.to_team, ap.detail, ns.category, round(ns.confidence, 6) AS confidence,
  CASE WHEN ap.kind IN ('accepted','corrected') THEN ns.suggested_team ELSE ap.from_team END AS from_team
FROM ap JOIN ns USING (event_id)""", once=True))
def apply_decisions(spark, sf):
    from queuemill.operators import decisions as D
    events = _events(spark, sf)
    made = L.decision_events(D.validated(V.entries(spark, sf)), events, L.max_id(events) + 1)
    return made.select("event_id", "ticket_id", "kind", "actor", "to_team", "detail", "category",
                       rounded(F.col("confidence")).alias("confidence"), "from_team")


@query("queue_board", with_ctes([*V.QUEUE, ("ss", STATS), ("tr", TEAM_REPORT)], """
SELECT 'stats' AS section, name, CAST(value AS DOUBLE) AS value FROM (
  UNPIVOT (SELECT CAST(total AS DOUBLE) AS total, CAST("open" AS DOUBLE) AS "open", CAST(resolved AS DOUBLE) AS resolved,
    CAST(duplicate AS DOUBLE) AS duplicate, CAST(ever_referred AS DOUBLE) AS ever_referred, CAST(teams AS DOUBLE) AS teams,
    reassignment_rate FROM ss) ON * INTO NAME name VALUE value)
UNION ALL SELECT 'workload', team || ':' || name, value FROM (
  UNPIVOT (SELECT * FROM tr) ON total, "open", resolved, inherited, passed_on INTO NAME name VALUE value)
UNION ALL SELECT 'handoff', from_team || '>' || to_team, n FROM (
  SELECT holder AS from_team, to_team, count(*) AS n FROM mv WHERE is_move AND holder IS NOT NULL
  GROUP BY ALL ORDER BY n DESC, from_team, to_team LIMIT 10)
UNION ALL SELECT 'queue', concat_ws(':', ref, status, team), hops FROM (SELECT * FROM st ORDER BY id DESC LIMIT 100)"""))
def queue_board(spark, sf):
    moves = _moves(spark, sf)
    folded = L.link_duplicates(L.fold(moves)).withColumns({
        "id": F.col("ticket_id"), "ref": S.ticket_ref(F.col("ticket_id"))})
    return L.queue_board(folded, moves)
