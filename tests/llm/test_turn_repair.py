"""Turn repair against plain enumeration, in stretches, over range borders and on edge rows."""

import hashlib
import itertools
import random
import re

import pytest

from queuemill.llm import turn_repair as T

GOAL = re.compile(r"(s?(ua)+)?")


def by_enumeration(rows):
    """Every way to edit, written out; at most one row is inserted in a gap, two at the end."""
    best = None
    for inserts in itertools.product(("", "u", "a"), repeat=len(rows)):
        for tail in ("", "u", "a", "ua", "au"):
            for edits in itertools.product("DKua", repeat=len(rows)):
                if any(e != "D" and f in ("b", "d") for e, (_, f) in zip(edits, rows)):
                    continue
                result = "".join(i + {"D": "", "K": r[0] or "?"}.get(e, e) for i, e, r in zip(inserts, edits, rows)) + tail
                if not GOAL.fullmatch(result):
                    continue
                cost = 3 * (sum(map(len, inserts)) + len(tail)) + sum(
                    4 if e == "D" else (0 if e == "K" else 3) + (3 if f else 0) for e, (_, f) in zip(edits, rows))
                audit = "".join("I" * len(i) + ("R" if e in "ua" else e) for i, e in zip(inserts, edits)) + "I" * len(tail)
                best = min(best, (cost, audit)) if best else (cost, audit)
    return best


def some_rows(rnd, n):
    return [(rnd.choice(["s", "u", "a", "x", ""]), rnd.choice(["", "", "", "t", "b", "d"])) for _ in range(n)]


def test_search_is_optimal():
    rnd = random.Random(3)
    for n in (0, 1, 2, 3):
        for _ in range(40 if n else 1):
            rows = some_rows(rnd, n)
            assert T.cheapest(rows) == by_enumeration(rows), rows


def test_stretches_change_nothing(monkeypatch):
    rnd = random.Random(4)
    cases = [some_rows(rnd, rnd.randint(0, 60)) for _ in range(150)]
    whole = [T.cheapest(rows) for rows in cases]
    for width in (1, 2, 7):
        monkeypatch.setattr(T, "WIDTH", width)
        assert [T.cheapest(rows) for rows in cases] == whole


@pytest.mark.parametrize("kinds", [["u"], ["s"], ["a"], ["x"], ["s", "u"]])
def test_long_conversations_are_searched_in_linear_time(kinds):
    rows = [(random.Random(i).choice(kinds), random.Random(i).choice(["", "t"])) for i in range(20_000)]
    cost, edits = T.cheapest(rows)
    assert len(re.findall("[KRD]", edits)) == 20_000 and cost >= 0


def in_python(rows):
    """(turn, role, text, gone) of a conversation to its result."""
    rows = sorted((r for r in rows if not r[3]), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return T._whole([r[0] for r in rows], [(r[1], r[2]) for r in rows])


def test_conversations_over_range_borders(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(7 if i % 3 else i % 11, i // 2, rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", "b", "", "c!", f"{i}?", f"{i}"]), i % 13 == 0)
            for i in range(900)]
    rows += [(None, None, "user", "x.", False), (3000, 1, "user", "y.", True)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone boolean").withColumnRenamed("gone", "gone")
    monkeypatch.setattr(T, "WIDTH", 50)
    by_id = {}
    for conv, *row in sorted(rows, key=str):
        by_id.setdefault(conv, []).append(row)
    # Rows with the same turn and role are ordered by digest: leave none of them.
    for conv, some in by_id.items():
        seen, unique = set(), []
        for row in some:
            if (row[0], row[1]) not in seen:
                seen.add((row[0], row[1]))
                unique.append(row)
        by_id[conv] = unique
    df = spark.createDataFrame([(c, *r) for c, some in by_id.items() for r in some], df.schema)
    got = {r["conv_id"]: r.asDict() for r in T.repair(df).collect()}
    assert set(got) == set(by_id)
    for conv, some in by_id.items():
        want = in_python(some)
        assert {k: got[conv][k] for k in want} == want, conv
    assert got[3000]["audit"] == "" and got[3000]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_edges(spark):
    ddl = "conv_id long, turn long, role string, text string, gone string, how int, copy int, done int, piece int"
    rows = [(1, 0, None, None), (1, None, "user", "x" * 200_000), (1, 2, "", ""), (None, None, None, None), (None, 1, "user", " \n"),
            (2, 1, "user", "a."), (2, 1, "user", "a."), (2, 5, "assistant", "漢字。 🙂!"), (4, -9223372036854775808, "user", "z")]
    got = {r["conv_id"]: r for r in T.repair(T.damaged(spark.createDataFrame([(*r, "x", 1, 1, 1, 1) for r in rows], ddl))).collect()}
    assert set(got) == {1, 2, None, 4} and all(r["cost"] >= 0 for r in got.values())
    assert T.repair(T.damaged(spark.createDataFrame([], ddl))).count() == 0
