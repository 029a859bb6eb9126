"""Events stored by buckets of the ticket: the same state, folded without an exchange."""

import random

from queuemill.operators import lifecycle as L
from queuemill.sources import io as IO
from test_ticket_state import DDL, some_events


def test_state_of_a_bucketed_table(spark, tmp_path):
    events = spark.createDataFrame(some_events(random.Random(5), 400, 15), DDL)
    IO.create_event_table(spark, "own_events", str(tmp_path / "a"), 4)
    for part in ("event_id < 200", "event_id >= 200", "event_id < 20"):
        IO.append_event_table(events.where(part), "own_events")
    IO.compact_event_table(spark, "own_events", "own_events_2", str(tmp_path / "b"), 4)
    table = spark.table("own_events_2")
    assert table.count() == 400 and len(table.inputFiles()) <= 4
    want = sorted(map(tuple, L.current_state(events).collect()))
    assert sorted(map(tuple, L.state_of_buckets(table).collect())) == want
    plan = L.fold(L.with_holder_in_buckets(table))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan
    spark.sql("DROP TABLE own_events")
    spark.sql("DROP TABLE own_events_2")
