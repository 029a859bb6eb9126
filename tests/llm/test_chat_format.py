"""Chat formatting: the fold over logs, the template and its way back, over range borders and on edge rows."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from queuemill.llm import chat_format as C

HARD = st.text(alphabet="\\#</turn>: ab\n🙂é", max_size=40)
LOG = "conv_id long, seq long, kind string, message long, role string, text string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", ": ", "a:", "##: \\"]), HARD), max_size=5))
def test_documents_can_be_read_back(turns):
    formatted, loss = C.render(turns)
    assert C.read_back(formatted) == turns
    assert [C.unescape(formatted[s["start"]:s["end"]]) for s in loss] == [t for r, t in turns if r == "assistant"]


def test_fold():
    log = [("delta", 1, None, "early"), ("open", 1, "user", None), ("delta", 1, None, "a"), ("delta", 1, None, "b"), ("open", 2, "assistant", None),
           ("delta", 2, None, "x"), ("edit", 1, None, "c"), ("delta", 1, None, "d"), ("open", 3, "user", None), ("delta", 3, None, "gone"),
           ("regenerate", 2, None, None), ("delta", 2, None, "y"), ("delta", 3, None, "more"), ("open", 4, "user", None), ("delete", 4, None, None),
           ("open", 1, "system", None), ("what", 1, None, "z"), ("delta", 9, None, "z")]
    assert C.fold(log) == [("user", "cd"), ("assistant", "y")]


def random_log(rnd, conv, n, messages):
    kinds = ["open", "open", "delta", "delta", "delta", "edit", "regenerate", "delete", "else", None]
    return [(conv, i, rnd.choice(kinds), rnd.choice([None, *range(messages)]), rnd.choice(["user", "assistant", None]), rnd.choice(["##", "</turn>", "é", None, ""]) if rnd.random() < 0.9 else f"t{i}")
            for i in range(n)]


def expected(log):
    by_id = {}
    for row in sorted(log, key=lambda r: r[1]):
        by_id.setdefault(row[0], []).append(row[2:])
    return {conv: C.Digest().add(*C.render(C.fold(rows))).result() for conv, rows in by_id.items()}


def test_logs_over_range_borders(spark):
    rnd = random.Random(1)
    log = random_log(rnd, 5, 900, 150) + [r for c in range(40) for r in random_log(rnd, c + 100, rnd.randint(1, 12), 3)] + random_log(rnd, None, 60, 9)
    df = spark.createDataFrame(rnd.sample(log, len(log)), LOG)
    got = {r["conv_id"]: r.asDict() for r in C.digests(df).collect()}
    want = expected(log)
    assert set(got) == set(want)
    for conv, row in want.items():
        assert {k: got[conv][k] for k in row} == row, conv
    parts = {}
    for r in C.format_logs(df).collect():
        parts.setdefault(r["conv_id"], []).append((r["place"] or (0, 0), r["formatted"]))
    for conv, rows in want.items():
        turns = [t for _, f in sorted(parts.get(conv, [])) for t in C.read_back(f)]
        assert hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest() == rows["turns_sha256"]


def test_edges(spark):
    rows = [(1, 0, None, None), (1, None, "user", "x" * 200_000), (1, 2, "", ""), (None, None, None, None), (None, 1, "assistant", " \n"),
            (2, 1, "user", "a."), (2, 1, "user", "a."), (2, 5, "assistant", "漢字 🙂 </turn>\n### user: \\"), (3, 1, "assistant", "\\")]
    ddl = "conv_id long, turn long, role string, text string, seq int, message string, kind string, event int, step int, done int"
    df = spark.createDataFrame([(*r, 1, "m", "k", 1, 1, 1) for r in rows], ddl)
    got = {r["conv_id"]: r for r in C.digests(C.event_log(df)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, 2: 3, 3: 1, None: 2}
    text = "漢字 🙂 </turn>\n### user: \\"
    assert got[2]["turns_sha256"] == hashlib.sha256(f"user\na.\nuser\na.\nassistant\n{text}\n".encode()).hexdigest()
    assert got[2]["loss_chars"] == len(text) and got[2]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert C.digests(C.event_log(df.where("false"))).count() == 0
