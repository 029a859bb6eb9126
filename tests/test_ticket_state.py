"""Keyed streaming state: equal to the batch fold in any order of arrival, and bounded."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from queuemill.operators import lifecycle as L
from queuemill.streaming import jobs as J
from queuemill.streaming import ticket_state as TS

DDL = "event_id long, ticket_id long, at string, kind string, to_team string, category string, detail string, resolution string"
KINDS = ["opened", "assigned", "referred", "referred", "referred", "settled", "resolved", "duplicate", "reopened", "note", "suggested", "enriched"]


def some_events(rnd, n, tickets):
    pick = lambda *options: rnd.choice(options)
    return [(i, 1 if rnd.random() < 0.4 else rnd.randrange(2, tickets), f"t{i}", rnd.choice(KINDS), pick("X", "Y", "Z", None), pick("c", "d", None),
             pick("why", "", None), pick("whole", "", None)) for i in range(n)]


def by_batch(spark, rows):
    folded = L.fold(L.with_holder(spark.createDataFrame(rows, DDL))).select(*L.FOLDED)
    return {r.ticket_id: tuple(r) for r in folded.collect()}


def replay(rows, keep, idle=False):
    """The processor's arithmetic without a stream; returns state and tail of one ticket."""
    state = {f: 0 if f in ("base_hops", "too_late") else None for f in TS.FIELDS}
    entries = []
    for batch in rows:
        tail = {e[0]: e for e in entries}
        for event in batch:
            TS.apply(state, tail, SimpleNamespace(**dict(zip(("event_id", "ticket_id", "at", "kind", "to_team", "category", "detail", "resolution"), event))))
        entries = sorted(tail.values())
        if len(entries) > keep:
            entries = TS.fold_front(state, entries, keep // 2)
        if idle:
            entries = TS.fold_front(state, entries, TS.IDLE_KEEP)
    count, last, _ = TS.hops(entries, state["base_team"])
    return state, entries, state["base_hops"] + count


@pytest.mark.parametrize("idle", [False, True])
def test_a_folded_tail_counts_the_same_hops(spark, idle):
    rnd = random.Random(3)
    rows = [e for e in some_events(rnd, 400, 3) if e[1] == 1]
    want = by_batch(spark, rows)[1]
    in_order = [rows[i:i + 25] for i in range(0, len(rows), 25)]
    for part in in_order:
        rnd.shuffle(part)
    state, entries, hops = replay(in_order, 20, idle)
    assert hops == want[L.FOLDED.index("hops")] and len(entries) <= 20 and state["too_late"] == 0
    state, _, _ = replay([*in_order, rows[:5]], 20, idle)
    assert state["too_late"] == sum(e[3] in L.HOLDING for e in rows[:5])


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    rnd = random.Random(4)
    rows = some_events(rnd, 300, 12)
    shuffled = rnd.sample(rows, len(rows)) + rows[:40]
    source, log, events = str(tmp_path / "in"), str(tmp_path / "log"), spark.createDataFrame(shuffled, DDL)
    read = []
    for i in range(3):
        part = events.where(F.pmod(F.xxhash64("event_id", "kind"), F.lit(3)) == i)
        part.coalesce(1).write.mode("append").parquet(source)
        stream = J.stream_ticket_state(J.read_stream(spark, source, events.schema, "parquet"), log, str(tmp_path / "cp"))
        stream.awaitTermination()
        read.append((sum(p["numInputRows"] for p in stream.recentProgress), part.count()))
    assert all(a == b for a, b in read)         # a batch reads its own events and no history
    got = {r.ticket_id: tuple(r) for r in J.latest_state(J.state_log(spark, f"{log}/state")).select(*L.FOLDED).collect()}
    assert got == by_batch(spark, rows)
