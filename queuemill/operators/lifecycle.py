"""Ticket life cycle: events are appended, state and workload are derived from them.

Events: event_id (order), ticket_id, at, kind, actor, to_team, category, confidence, detail, and
where a ticket was resolved with a text, `resolution`: the ticket keeps more of it than the detail.
All folds are partial aggregates over `max_by`, so a ticket with very many events is reduced
before it is shuffled; only the holder before an event needs order, and that is segmented.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuemill import fixed
from queuemill.functions import scalars as S
from queuemill.operators.ranking import SEGMENT_ROWS, order_segment, previous_value, segmented_rank
from queuemill.runtime import blank_to_null, materialise, present, ratio, rounded

HOLDING = ("opened", "assigned", "referred", "settled")
CLOSING = ("resolved", "duplicate")

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ticket_id", T.LongType()),
    T.StructField("at", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("actor", T.StringType()), T.StructField("from_team", T.StringType()),
    T.StructField("to_team", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("detail", T.StringType()),
    T.StructField("resolution", T.StringType())])


def with_holder(events: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Adds `holder` (team just before the event) and `is_move` (a referral that changes hands)."""
    sets_team = F.when(F.col("kind").isin(*HOLDING), F.col("to_team"))
    held = previous_value(events, "ticket_id", "event_id", sets_team, "holder", segment_rows)
    moved = F.col("holder").isNull() | (F.col("holder") != F.col("to_team"))
    return held.withColumn("is_move", F.coalesce((F.col("kind") == "referred") & moved, F.lit(False)))


def with_holder_in_buckets(events: DataFrame) -> DataFrame:
    """`with_holder` for events stored by buckets of the ticket: the tickets lie together, so one window over the order of the ids
    needs no exchange. A ticket with a large share of all events is one task there; `with_holder` cuts it into segments."""
    sets_team = F.when(F.col("kind").isin(*HOLDING), F.col("to_team"))
    before = W.partitionBy("ticket_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    held = events.withColumn("holder", F.last(sets_team, ignorenulls=True).over(before))
    moved = F.col("holder").isNull() | (F.col("holder") != F.col("to_team"))
    return held.withColumn("is_move", F.coalesce((F.col("kind") == "referred") & moved, F.lit(False)))


def state_of_buckets(events: DataFrame) -> DataFrame:
    """`current_state` over a bucketed event table: folded where the events lie."""
    return shown_state(fold(with_holder_in_buckets(events)))


def fold(moves: DataFrame) -> DataFrame:
    """One row per ticket from events that carry `holder` and `is_move`."""
    kind, last = F.col("kind"), F.col("event_id")
    latest = lambda value, when: F.max_by(value, F.when(when, last))
    status = (F.when(kind == "resolved", fixed.RESOLVED).when(kind == "duplicate", fixed.DUPLICATE)
              .when(kind == "referred", fixed.REFERRED).otherwise(fixed.OPEN))
    sets_status = kind.isin("opened", "reopened", *CLOSING) | F.col("is_move")
    ends = kind.isin("reopened", *CLOSING)
    # Events without the column, or from before it, have the whole text in their detail.
    full = F.coalesce("resolution", "detail") if "resolution" in moves.columns else F.col("detail")
    return moves.groupBy("ticket_id").agg(
        F.min_by("at", F.when(kind == "opened", last)).alias("opened_at"),
        latest(F.col("category"), kind.isin("opened", "settled") & F.col("category").isNotNull()).alias("category"),
        latest(F.col("to_team"), kind.isin(*HOLDING) & F.col("to_team").isNotNull()).alias("team"),
        latest(status, sets_status).alias("status"),
        latest(F.when(kind.isin(*CLOSING), F.col("at")), ends).alias("closed_at"),
        latest(blank_to_null(full), kind == "resolved").alias("resolution"),
        latest(F.col("detail"), kind == "duplicate").alias("duplicate_ref"),
        F.count_if("is_move").alias("hops"),
        F.max("event_id").alias("last_event_id"),
        F.bool_or(ends).alias("closed_or_reopened"),
        F.bool_or(kind == "resolved").alias("was_resolved"),
        F.bool_or(kind == "duplicate").alias("was_duplicate"))


FOLDED = ("ticket_id", "opened_at", "category", "team", "status", "closed_at", "resolution", "duplicate_ref", "hops", "last_event_id")


def refold(history: DataFrame) -> DataFrame:
    """Folded rows from all events of some tickets, in whatever order they arrived; an event delivered twice counts once."""
    return fold(with_holder(history.dropDuplicates(["ticket_id", "event_id"]))).select(*FOLDED)


def _blank(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [F.trim(F.coalesce(c, F.lit(""))) == "" for c in columns])


def rejected(arrivals: DataFrame) -> DataFrame:
    """(ord, at, requester, reason): arrivals that open no ticket."""
    reason = F.when(F.col("ord").isNull(), "without a number").when(_blank("subject", "description"), "without subject and description")
    return arrivals.select("ord", "at", "requester", reason.alias("reason")).where("reason IS NOT NULL")


def intake(arrivals: DataFrame, scored: DataFrame, last_id: int, first_event_id: int,
           abstain_below: float = fixed.ABSTAIN_BELOW, first_line: str = fixed.FIRST_LINE) -> tuple[DataFrame, DataFrame]:
    """New tickets opened with the suggested team; a weak suggestion goes to the first line, and a
    ticket without scores is opened all the same. Returns (tickets, events).

    Arrivals: ord, at, subject, description, requester. Scored: ord, category, team, confidence.
    """
    written = arrivals.where(~_blank("subject", "description") & F.col("ord").isNotNull())
    weak = F.coalesce(F.col("confidence") < abstain_below, F.lit(False))
    triaged = written.join(scored.withColumnRenamed("team", "proposed"), "ord", "left").withColumns({
        "abstained": weak, "team": F.when(weak, F.lit(first_line)).otherwise(F.col("proposed")),
        "actor": F.coalesce(blank_to_null(F.col("requester")), F.lit("requester")), "arm": F.lit("B")})
    opened = open_tickets(triaged, last_id)
    detail = F.when(F.col("abstained"), F.concat(
        F.lit("abstained at "), F.col("confidence").cast("string"), F.lit(" -- would have said "), F.col("proposed"),
        F.lit("; sent to the first line instead")))
    step = lambda n, kind, actor, text: F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), actor.alias("actor"), text.alias("detail"))
    none = F.lit(None).cast("string")
    steps = F.explode(F.array(step(0, "opened", F.col("actor"), none), step(1, "suggested", F.lit("model"), detail))).alias("s")
    events = opened.select("*", steps).select(
        ((F.col("id") - F.lit(last_id + 1)) * 2 + F.col("s.n") + F.lit(first_event_id)).alias("event_id"),
        F.col("id").alias("ticket_id"), "at", "s.kind", F.col("s.actor").alias("actor"), F.col("team").alias("to_team"),
        "category", "confidence", F.col("s.detail").alias("detail"))
    return opened, events


def current_state(events: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Team, category, status, closing time, hops ... of every ticket."""
    return shown_state(fold(with_holder(events, segment_rows)))


def shown_state(folded: DataFrame) -> DataFrame:
    linked = link_duplicates(folded)
    return linked.select(
        F.col("ticket_id").alias("id"), S.ticket_ref(F.col("ticket_id")).alias("ref"), "opened_at",
        "category", "team", "status", "closed_at", "resolution", "duplicate_of", "hops", "last_event_id")


def parsed_ref(value: Column) -> Column:
    """The id a reference or a number stands for; a reference must have the exact format."""
    text = F.trim(value)
    named = F.regexp_extract(text, r"^MU-0*(\d+)$", 1)
    number = F.when(named != "", named).try_cast("bigint")
    by_ref = F.when(S.ticket_ref(number) == text, number)
    return F.when(S.is_numeric_ref(value), text.try_cast("bigint")).otherwise(by_ref)


def link_duplicates(folded: DataFrame) -> DataFrame:
    """duplicate_of from `duplicate_ref`: numbers are taken as they are, references must exist."""
    numeric = S.is_numeric_ref(F.col("duplicate_ref"))
    wanted = folded.withColumn("_id", parsed_ref(F.col("duplicate_ref"))).withColumn("_asks", F.coalesce(~numeric & F.col("_id").isNotNull(), F.lit(False)))
    # Only tickets closed by reference take part in the look-up: nearly all others would share a NULL key. Of
    # the tickets asked for, each is looked up once, however many duplicates it has.
    asked = wanted.where("_asks").select("_id").distinct()
    known = asked.join(folded.select(F.col("ticket_id").alias("_id")), "_id", "left_semi").withColumn("_known", F.col("_id"))
    found = wanted.where("_asks").join(known, "_id", "left").withColumn("duplicate_of", F.col("_known")).drop("_known")
    rest = wanted.where("NOT _asks").withColumn("duplicate_of", F.when(numeric, F.col("_id")))
    return found.select(*rest.columns).unionByName(rest).drop("_id", "_asks")


def resolve_refs(values: DataFrame, tickets: DataFrame, ref: str = "ref", out: str = "ticket_id") -> DataFrame:
    """Adds the id of an existing ticket, NULL where there is none."""
    known = tickets.select(F.col("id").alias("_known"))
    return (values.withColumn("_id", parsed_ref(F.col(ref)))
            .join(known, F.col("_id") == F.col("_known"), "left")
            .withColumn(out, F.col("_known")).drop("_id", "_known"))


# ---------------------------------------------------------------- reports

EMPTY_TEAM = ("total", "open", "resolved", "inherited", "passed_on")


def team_report(state: DataFrame, moves: DataFrame) -> DataFrame:
    """What every team holds, took over and handed on; absent parts count 0.

    Both sides are reduced to a few rows per team before they meet in one aggregate.
    """
    zero = F.lit(0).cast("long")
    held = state.where(F.col("team").isNotNull()).groupBy("team").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status").isin(fixed.OPEN, fixed.REFERRED)).alias("open"),
        F.count_if(F.col("status") == fixed.RESOLVED).alias("resolved"),
        zero.alias("inherited"), zero.alias("passed_on"))
    edges = moves.where("is_move").groupBy("holder", "to_team").agg(F.count(F.lit(1)).alias("n"))
    sides = edges.select(F.explode(F.array(
        F.struct(F.col("to_team").alias("team"), F.col("n").alias("inherited"), zero.alias("passed_on")),
        F.struct(F.col("holder").alias("team"), zero.alias("inherited"), F.col("n").alias("passed_on")))).alias("s"))
    flows = sides.select("s.team", zero.alias("total"), zero.alias("open"), zero.alias("resolved"),
                         "s.inherited", "s.passed_on").where(F.col("team").isNotNull())
    return held.unionByName(flows).groupBy("team").agg(*[F.sum(c).alias(c) for c in EMPTY_TEAM])


def team_workload(events: DataFrame) -> DataFrame:
    moves = with_holder(events)
    return sort_workload(team_report(fold(moves), moves))


def sort_workload(report: DataFrame) -> DataFrame:
    return report.orderBy(F.desc("open"), F.desc("total"), "team")


def handoffs(moves: DataFrame, limit: int = 10) -> DataFrame:
    """The most common team-to-team moves; a referral out of no team is not one."""
    return (moves.where(F.col("is_move") & F.col("holder").isNotNull())
            .groupBy(F.col("holder").alias("from_team"), "to_team").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "from_team", "to_team").limit(limit))


def queue_stats(state: DataFrame) -> DataFrame:
    status = F.col("status")
    counts = state.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status.isin(fixed.OPEN, fixed.REFERRED)).alias("open"),
        F.count_if(status == fixed.RESOLVED).alias("resolved"),
        F.count_if(status == fixed.DUPLICATE).alias("duplicate"),
        F.count_if(F.col("hops") > 0).alias("ever_referred"),
        F.count_distinct("team").alias("teams"))
    return counts.withColumn("reassignment_rate", rounded(ratio(F.col("ever_referred"), F.col("total")), 3))


def reassigned_share(tickets: DataFrame, stats: DataFrame) -> DataFrame:
    """The recorded share against the live rate, and which is higher."""
    corpus = tickets.agg(rounded(F.avg((F.col("reassigned") == "Yes").cast("double")), 3).alias("corpus_rate"))
    both = corpus.withColumn("live_rate", F.lit(None).cast("double")).unionByName(
        stats.select(F.lit(None).cast("double").alias("corpus_rate"), F.col("reassignment_rate").alias("live_rate")))
    one = both.agg(F.max("corpus_rate").alias("corpus_rate"), F.max("live_rate").alias("live_rate"))
    direction = (F.when(F.col("live_rate") > F.col("corpus_rate"), "above")
                 .when(F.col("live_rate") < F.col("corpus_rate"), "below")
                 .when(F.col("live_rate").isNotNull(), "level with"))
    return one.withColumn("direction", direction)


def queue(state: DataFrame, status: str | None = None, team: str | None = None, limit: int = 100) -> DataFrame:
    """Newest tickets first, optionally of one status or team."""
    if status:
        state = state.where(F.col("status") == status)
    if team:
        state = state.where(F.col("team") == team)
    return state.orderBy(F.desc("id")).limit(limit)


def journey(events: DataFrame, ticket_id: int | None = None) -> DataFrame:
    """The events of one ticket (or of each), oldest first, beside the ticket's state."""
    mine = events if ticket_id is None else events.where(F.col("ticket_id") == ticket_id)
    moves = with_holder(mine)
    state = fold(moves).select("ticket_id", F.col("status").alias("ticket_status"),
                               F.col("team").alias("ticket_team"), F.col("hops").alias("ticket_hops"))
    shown = moves.withColumn("from_team", F.when(F.col("is_move"), F.col("holder")))
    return shown.join(state, "ticket_id").orderBy("ticket_id", "event_id")


def all_teams(state: DataFrame, events: DataFrame) -> DataFrame:
    named = state.select("team").union(events.select(F.col("to_team").alias("team")))
    return named.where(F.col("team").isNotNull()).distinct().orderBy("team")


def known_teams(teams: DataFrame, model_classes: DataFrame) -> DataFrame:
    both = teams.select("team").union(model_classes.select("team"))
    return both.where(present(F.col("team"))).distinct().orderBy("team")


# ---------------------------------------------------------------- new tickets and commands

def max_id(events: DataFrame) -> int:
    """The highest ticket id in use: one number."""
    return events.agg(F.coalesce(F.max("ticket_id"), F.lit(0))).first()[0]


def max_event_id(events: DataFrame) -> int:
    return events.agg(F.coalesce(F.max("event_id"), F.lit(-1))).first()[0]


#: Tickets ranked by one task: they carry their texts, a few KB each.
TICKETS_RANKED = 1 << 14


def open_tickets(arrivals: DataFrame, last_id: int, order: str = "ord") -> DataFrame:
    """New ids in arrival order, the reference made from the id, bounded texts."""
    cut = arrivals.withColumns({c: S.truncated(F.col(c), fixed.TICKET_LIMITS[c]) for c in ("subject", "description")})
    numbered = segmented_rank(cut, [], order_segment(arrivals, order, TICKETS_RANKED), [order])
    new_id = F.col("rk") + F.lit(last_id)
    return numbered.withColumns({"id": new_id, "ref": S.ticket_ref(new_id), "status": F.lit(fixed.OPEN), "hops": F.lit(0).cast("long")}).drop("rk")


# Actions of the queue, the events they append and the messages for what is missing. A note is
# an event a service may append, not an action of the queue.
ACTION_KIND = {"refer": "referred", "resolve": "resolved", "reopen": "reopened",
               "assign": "assigned", "duplicate": "duplicate", "note": "enriched"}
QUEUE_ACTIONS = ("refer", "resolve", "reopen", "assign", "duplicate")
NEED_TEAM = {"refer": "Choose a team to refer to.", "assign": "Choose a team."}


def checked_commands(commands: DataFrame, tickets: DataFrame, actions=QUEUE_ACTIONS) -> DataFrame:
    """Adds ticket_id and `error`: no such ticket, no team, or an action that isn't one of `actions`."""
    found = resolve_refs(commands, tickets)
    action = F.col("action")
    error = F.when(F.col("ticket_id").isNull(), "no such ticket")
    for name, message in NEED_TEAM.items():
        error = error.when((action == name) & ~present(F.trim("team")), message)
    error = error.when(~F.coalesce(action.isin(*actions), F.lit(False)), F.concat(F.lit("unknown action: "), F.coalesce(action, F.lit(""))))
    return found.withColumn("error", error)


def command_events(commands: DataFrame, tickets: DataFrame, events: DataFrame, actions=QUEUE_ACTIONS) -> DataFrame:
    """The events a batch of commands appends; referrals to the holder append nothing."""
    base = max_event_id(events)
    valid = checked_commands(commands, tickets, actions).where(F.col("error").isNull())
    action = F.col("action")
    kind = F.create_map(*[F.lit(x) for pair in ACTION_KIND.items() for x in pair])[action]
    long_text = F.substring("detail", 1, fixed.TICKET_LIMITS["detail"])
    detail = (F.when(action == "duplicate", F.col("of"))
              .when(action == "resolve", F.coalesce(long_text, F.lit("")))
              .when(action.isin("refer", "reopen", "note"), F.col("detail")))
    new = valid.select(
        (F.col("command_id") + F.lit(base + 1)).alias("event_id"), "ticket_id", "at", kind.alias("kind"), "actor",
        F.when(action.isin(*NEED_TEAM), F.trim("team")).alias("to_team"),
        F.lit(None).cast("string").alias("category"), F.lit(None).cast("double").alias("confidence"),
        detail.alias("detail"),
        F.when(action == "resolve", blank_to_null(F.substring("detail", 1, fixed.TICKET_LIMITS["resolution"]))).alias("resolution"))
    return settle(events, new, base)


def settle(events: DataFrame, new: DataFrame, base: int) -> DataFrame:
    """Which of the new events stand, with the team each was taken from."""
    touched = events.join(new.select("ticket_id").distinct(), "ticket_id", "left_semi")
    seen = with_holder(touched.unionByName(new, allowMissingColumns=True))
    stands = (F.col("kind") != "referred") | F.col("is_move")
    moved = F.col("kind").isin("referred", "assigned")
    return (seen.where((F.col("event_id") > base) & stands)
            .withColumn("from_team", F.when(moved, F.col("holder"))).drop("holder", "is_move"))


def with_tickets(decisions: DataFrame, events: DataFrame, first_new_id: int) -> DataFrame:
    """Adds ticket_id and `_new`. New ids go up by decision_id from `first_new_id`.

    A reference to an id that this batch gives out counts only if a decision before it opened that ticket, which
    depends on how many of those before it do so in turn. Each round counts the surely new decisions before a
    doubtful one, and the doubtful ones; where the answer is the same for all and for none of these, it is settled. The
    first doubtful decision is settled in every round; batches without such references need no round.
    """
    known = events.select(F.col("ticket_id").alias("id")).distinct()
    matched = resolve_refs(decisions, known, ref="db_ref").withColumn("_ref", parsed_ref(F.col("db_ref")))
    ahead = F.coalesce(F.col("ticket_id").isNull() & (F.col("_ref") >= first_new_id), F.lit(False))
    marked = matched.withColumn("_state", F.when(F.col("ticket_id").isNotNull(), "old").when(ahead, "doubt").otherwise("new"))
    while True:
        marked = materialise(marked, "references")
        if marked.where("_state = 'doubt'").isEmpty():
            break
        doubtful = marked.where("_state <> 'old'").select("decision_id", "_ref", "_state")
        segment = order_segment(doubtful, "decision_id")
        both = segmented_rank(doubtful, [], segment, ["decision_id"], rank="_all")      # place among new and doubtful ones
        doubt = segmented_rank(doubtful.where("_state = 'doubt'"), [], segment, ["decision_id"], rank="_doubt")
        counts = both.where("_state = 'doubt'").select("decision_id", "_ref", "_all").join(doubt.select("decision_id", "_doubt"), "decision_id")
        most, least = F.col("_all") - 1, F.col("_all") - F.col("_doubt")
        wanted = F.col("_ref") - F.lit(first_new_id)
        settled = counts.select("decision_id", F.when(wanted < least, "old").when(wanted >= most, "new").otherwise("doubt").alias("_settled"))
        marked = (marked.join(settled, "decision_id", "left")
                  .withColumn("ticket_id", F.when(F.col("_settled") == "old", F.col("_ref")).otherwise(F.col("ticket_id")))
                  .withColumn("_state", F.coalesce("_settled", "_state")).drop("_settled"))
    new = marked.where("_state = 'new'").drop("ticket_id")
    fresh = segmented_rank(new, [], order_segment(new, "decision_id"), ["decision_id"])
    fresh = fresh.withColumn("ticket_id", F.col("rk") + F.lit(first_new_id - 1)).drop("rk")
    every = marked.where("_state = 'old'").unionByName(fresh)
    return every.withColumn("_new", F.col("_state") == "new").drop("_state", "_ref")


def decision_events(decisions: DataFrame, events: DataFrame, first_new_id: int) -> DataFrame:
    """One decision becomes up to five events of one ticket.

    A decision on an unknown or missing reference opens a ticket. On a known one, also one that an earlier
    decision of this batch opened, the settled category and team are written without a hop (`settled`).
    """
    base = max_event_id(events)
    every = materialise(with_tickets(decisions, events, first_new_id), "decided")

    category = S.choice(F.col("chosen_category"), F.col("suggested_category"))
    team = S.choice(F.col("chosen_team"), F.col("suggested_team"))
    nothing, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")

    def step(number, condition, kind, to_team=nothing, category=nothing, confidence=no_number, detail=nothing):
        return F.when(condition, F.struct(
            F.lit(number).alias("step"), kind.alias("kind"), to_team.alias("to_team"),
            category.alias("category"), confidence.alias("confidence"), detail.alias("detail")))

    over = F.col("category_overridden") | F.col("team_overridden")
    referred = present(F.col("referred_to"))
    duplicate = ~referred & present(F.col("closed_as_duplicate_of"))
    reused = ~referred & ~duplicate & present(F.col("resolved_with"))
    new = F.col("_new")
    steps = F.array(
        step(0, new, F.lit("opened"), team, category, F.col("confidence_team")),
        step(0, ~new & (category.isNotNull() | team.isNotNull()), F.lit("settled"), team, category),
        step(1, F.col("rejected"), F.lit("rejected"), category=F.col("suggested_category"),
             confidence=F.col("confidence_team")),
        step(2, F.col("enriched"), F.lit("enriched"), confidence=F.col("confidence_after"),
             detail=F.substring("text_after", 1, fixed.TICKET_LIMITS["detail"])),
        step(3, over, F.when(F.col("rejected"), "corrected").otherwise("accepted"),
             to_team=F.col("chosen_team"), category=category),
        step(4, referred, F.lit("referred"), to_team=F.col("referred_to"), detail=F.lit("referred from the queue")),
        step(4, duplicate, F.lit("duplicate"), detail=F.col("closed_as_duplicate_of")),
        step(4, reused, F.lit("resolved"),
             detail=F.concat(F.lit("reused the fix from "), F.col("resolved_with"))))
    actor = F.coalesce(blank_to_null(F.col("actor")), F.lit("resolver"))
    exploded = every.select("decision_id", "ticket_id", "at", actor.alias("actor"), "suggested_team",
                            F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s"))
    new_events = exploded.select(
        (F.col("decision_id") * 8 + F.col("s.step") + F.lit(base + 1)).alias("event_id"), "ticket_id", "at",
        "s.kind", "actor", "s.to_team", "s.category", "s.confidence", "s.detail", "suggested_team")
    settled = settle(events, new_events, base)
    return settled.withColumn("from_team", F.when(
        F.col("kind").isin("accepted", "corrected"), F.col("suggested_team")).otherwise(F.col("from_team"))).drop("suggested_team")


def queue_board(state: DataFrame, moves: DataFrame, limit: int = 100, pairs: int = 10) -> DataFrame:
    """Stats, workload, hand-offs and queue page in one long report: (section, name, value)."""
    stats = queue_stats(state)
    counts = ("total", "open", "resolved", "duplicate", "ever_referred", "teams", "reassignment_rate")
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in counts]))
    part = lambda df, section, name, value: df.select(
        F.lit(section).alias("section"), name.alias("name"), value.cast("double").alias("value"))
    head = stats.select(rows.alias("r"))
    work = team_report(state, moves)
    load = work.select("team", F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in EMPTY_TEAM])).alias("r"))
    return (part(head, "stats", F.col("r.name"), F.col("r.value"))
            .unionByName(part(load, "workload", F.concat_ws(":", "team", "r.name"), F.col("r.value")))
            .unionByName(part(handoffs(moves, pairs), "handoff", F.concat_ws(">", "from_team", "to_team"), F.col("n")))
            .unionByName(part(queue(state, limit=limit), "queue", F.concat_ws(":", "ref", "status", "team"), F.col("hops"))))
