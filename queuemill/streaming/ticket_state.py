"""State of a ticket kept by key while its events arrive, in any order.

What a later event simply overrides is one value with the id of the event that set it. Hops need the order of the events that name a
team: those are kept as a list (the tail) and read in order of their ids. When a tail has grown past `keep` entries, or a timer finds
the ticket idle, all but its newest entries are folded into a count and the team that held the ticket then. So a batch reads its own
events and one state per ticket it touches, however long the history is, and the state of a ticket is bounded.

Events delivered twice count once. An event that names a team and is older than the folded part of the tail cannot change the hops
any more: it is counted in `too_late`, and tickets with such events are to be folded anew from the event table. Everything else of
such an event takes effect. An event without an id counts as too late.
"""

from __future__ import annotations

from typing import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from queuemill import fixed
from queuemill.operators.lifecycle import CLOSING, HOLDING

KEEP = 4096             # entries a tail may have before its older half is folded
IDLE_KEEP = 16          # entries an idle ticket keeps
IDLE_MS = 3_600_000     # a ticket is idle after this

#: A value and the id of the event that set it.
SLOTS = ("opened_at", "category", "team", "status", "closed_at", "resolution", "duplicate_ref")
STATE = ", ".join(f"{s}_id long, {s} string" for s in SLOTS) + ", last_event_id long, base_id long, base_team string, base_hops long, base_move long, too_late long"
FIELDS = [f.split(" ")[0] for f in STATE.split(", ")]
TAIL = "event_id long, referred boolean, to_team string"
OUT = ("ticket_id long, opened_at string, category string, team string, status string, closed_at string, resolution string, duplicate_ref string, "
       "hops long, last_event_id long, too_late long")
STATUS = {"resolved": fixed.RESOLVED, "duplicate": fixed.DUPLICATE, "opened": fixed.OPEN, "reopened": fixed.OPEN}


def hops(tail: list[tuple], team: str | None) -> tuple[int, int | None, str | None]:
    """Number of moves along a tail in order, the id of the last of them, and who holds the ticket behind it."""
    count, last = 0, None
    for event_id, referred, to_team in tail:
        # The first referral is a move also without a team; later ones must name another team.
        if referred and (team is None or to_team is not None and to_team != team):
            count, last = count + 1, event_id
        team = team if to_team is None else to_team
    return count, last, team


def fold_front(state: dict, tail: list[tuple], keep: int) -> list[tuple]:
    """Moves all but the newest `keep` entries of a tail into the state."""
    front, rest = tail[:max(0, len(tail) - keep)], tail[max(0, len(tail) - keep):]
    if front:
        count, last, state["base_team"] = hops(front, state["base_team"])
        state["base_hops"] += count
        state["base_move"] = last if last is not None else state["base_move"]
        state["base_id"] = front[-1][0]
    return rest


def apply(state: dict, tail: dict, event) -> None:
    """One event, at its place in the order of ids."""
    number, kind = event.event_id, event.kind
    if number is None:
        state["too_late"] += 1
        return

    def newest(slot: str, value) -> None:
        if state[f"{slot}_id"] is None or number >= state[f"{slot}_id"]:
            state[f"{slot}_id"], state[slot] = number, value

    if kind == "opened" and (state["opened_at_id"] is None or number <= state["opened_at_id"]):
        state["opened_at_id"], state["opened_at"] = number, event.at
    if kind in ("opened", "settled") and event.category is not None:
        newest("category", event.category)
    if kind in STATUS:
        newest("status", STATUS[kind])
    if kind in CLOSING or kind == "reopened":
        newest("closed_at", event.at if kind in CLOSING else None)
    if kind == "resolved":
        full = getattr(event, "resolution", None)
        newest("resolution", (event.detail if full is None else full) or None)
    if kind == "duplicate":
        newest("duplicate_ref", event.detail)
    if kind in HOLDING:
        if event.to_team is not None:
            newest("team", event.to_team)
        if state["base_id"] is not None and number <= state["base_id"]:
            state["too_late"] += 1
        else:
            tail[number] = (number, kind == "referred", event.to_team)
    state["last_event_id"] = number if state["last_event_id"] is None else max(state["last_event_id"], number)


class TicketState(StatefulProcessor):
    """Keyed by ticket_id; emits the state of every ticket a batch touches."""

    def __init__(self, keep: int = KEEP, idle_ms: int = IDLE_MS):
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", STATE)
        self.tail = handle.getListState("tail", TAIL)

    def _read(self) -> tuple[dict, list[tuple]]:
        held = self.folded.get()
        state = dict(zip(FIELDS, held)) if held is not None else {f: 0 if f in ("base_hops", "too_late") else None for f in FIELDS}
        return state, [tuple(e) for e in self.tail.get()] if self.tail.exists() else []

    def _write(self, state: dict, tail: list[tuple]) -> None:
        self.folded.update(tuple(state[f] for f in FIELDS))
        if tail:
            self.tail.put(tail)
        else:
            self.tail.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, entries = self._read()
        tail = {e[0]: e for e in entries}
        for event in rows:
            apply(state, tail, event)
        entries = sorted(tail.values())
        if len(entries) > self.keep:
            entries = fold_front(state, entries, self.keep // 2)
        self._write(state, entries)
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if len(entries) > IDLE_KEEP:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        count, last, _ = hops(entries, state["base_team"])
        moves = [m for m in (state["base_move"], last) if m is not None]
        status = state["status"]
        if moves and (state["status_id"] is None or max(moves) > state["status_id"]):
            status = fixed.REFERRED
        yield Row(ticket_id=key[0], opened_at=state["opened_at"], category=state["category"], team=state["team"], status=status,
                  closed_at=state["closed_at"], resolution=state["resolution"], duplicate_ref=state["duplicate_ref"],
                  hops=state["base_hops"] + count, last_event_id=state["last_event_id"], too_late=state["too_late"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, entries = self._read()
        self._write(state, fold_front(state, entries, IDLE_KEEP))
        return iter([])

    def close(self) -> None:
        pass
