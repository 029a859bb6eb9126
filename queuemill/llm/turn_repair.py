"""Repair of the turn structure of conversations at the least cost of edits.

A conversation must read as an optional system row and then pairs of a user and an assistant row, or be empty. Rows may be kept (0),
given the role user or assistant (3) or deleted (4); empty user or assistant rows may be put in anywhere (3). A row without text and
a row that repeats an earlier one must go; a row that stays but breaks off costs 3 more. Of the cheapest ways the one whose edits,
written K, R, D, I in order, come first in ASCII is taken.

The search is a depth-first branch and bound with an explicit stack: a prefix is dropped when a cheaper (or equally cheap and
smaller) one reached the same node, or when its cost and the lower bound of the rows behind it cannot beat the incumbent. The bound
solves a relaxed task, in which a system row alone may end a conversation. Long conversations are cut into stretches of at most
WIDTH rows; for a stretch the search gives the best edits from every state before it to every state behind it, and a fold over
stretches picks the states. So neither a long conversation nor one with a third of all rows has to fit in one task.

Order: turn (nulls first), then role, then a digest of the text. Nulls in role or text read as one space. Rows of conv_id NULL are
one conversation. Repeated rows are rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from queuemill.llm.ranges import groups, in_ranges, same, this_piece
from queuemill.runtime import materialise

REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3        # costs
WIDTH = 1024                                        # rows searched at a time
BLANKS = " \t\n\v\f\r"
LEGAL = frozenset({"su", "ua", "au"})
START, SYSTEM, USER, ASSISTANT = range(4)           # what the last row that stays was
STATES = (START, SYSTEM, USER, ASSISTANT)
AFTER = (USER, USER, ASSISTANT, USER)               # the row a user or assistant may follow with
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {USER: "u", ASSISTANT: "a"}
CLASS = (0, 1, 2, 1)                                # the bound doesn't tell SYSTEM from ASSISTANT
TAILS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}     # what completes a conversation that ends here
NEVER = 1 << 60


# ---------------------------------------------------------------- faults

def fault(text: str, repeated: bool) -> str:
    """b blank, d duplicate, t truncated, or nothing."""
    kept = text.rstrip(BLANKS)
    if not kept:
        return "b"
    return "d" if repeated else "" if kept[-1] in ".!?" else "t"


def faults(rows: list[tuple[str, str]]) -> list[str]:
    seen, out = set(), []
    for row in rows:
        found = fault(row[1], row in seen)
        if found != "b":
            seen.add(row)
        out.append(found)
    return out


def illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


# ---------------------------------------------------------------- search

def row_moves(state: int, initial: str, found: str) -> list[tuple[str, int, int]]:
    """(edit, cost, state behind it) of one row."""
    moves = [("D", DELETE, state)]
    if found in ("b", "d"):
        return moves
    extra, following = (CUT_OFF if found else 0), AFTER[state]
    if initial == "s" and state == START:
        moves.append(("K", extra, SYSTEM))
    if initial == INITIALS[following]:
        moves.append(("K", extra, following))
    else:
        moves.append(("R", REROLE + extra, following))
    return moves


def lower_bounds(rows: list[tuple[str, str]], exits: dict[int, str]) -> list[list[int]]:
    """For every place and class of states the cost of the rows from there on in the relaxed task."""
    low = [min((INSERT * len(tail) for state, tail in exits.items() if CLASS[state] == c), default=NEVER) for c in range(3)]
    bounds, of_class = [low], (START, ASSISTANT, USER)
    for initial, found in reversed(rows):
        step = [min(cost + low[CLASS[to]] for _, cost, to in row_moves(of_class[c], initial, found)) for c in range(3)]
        low = [min(step[c], INSERT + step[CLASS[AFTER[of_class[c]]]]) for c in range(3)]
        bounds.append(low)
    return bounds[::-1]


def search(rows: list[tuple[str, str]], entry: int, exits: dict[int, str]) -> tuple[int, str] | None:
    """The least (cost, edits) from state `entry` to one of `exits`, closed by the inserts it names. Rows: (initial, fault).
    Apart from those, rows are inserted only right before a row that is there."""
    last, low = len(rows), lower_bounds(rows, exits)
    reached = [[None] * len(STATES) for _ in range(last + 1)]       # best prefix of every node
    best = None
    stack = [("", 0, 0, entry)]
    while stack:
        edits, cost, at, state = stack.pop()
        held = reached[at][state]
        if held is not None and held < (cost, edits):
            continue
        least = cost + low[at][CLASS[state]]
        if least >= NEVER or best is not None and (least > best[0] or least == best[0] and edits > best[1][:len(edits)]):
            continue
        if at == last:
            if state in exits:
                done = (cost + INSERT * len(exits[state]), edits + exits[state])
                best = done if best is None else min(best, done)
            continue
        following = []
        for edit, price, to in [*row_moves(state, *rows[at]), ("I", INSERT, AFTER[state])]:
            place = at + (edit != "I")
            prefix = (cost + price, edits + edit)
            if reached[place][to] is None or prefix < reached[place][to]:
                reached[place][to] = prefix
                following.append((prefix[0] + low[place][CLASS[to]], prefix[1], prefix[0], place, to))
        following.sort(reverse=True)                                # the most promising, then the smallest, is on top
        stack += [node[1:] for node in following]
    return best


def between(rows: list[tuple[str, str]], entry: int, leave: int) -> tuple[int, str] | None:
    """The least (cost, edits) of a stretch from one state to another. Nothing or a single system row stays for the first two."""
    if leave in (USER, ASSISTANT):
        return search(rows, entry, {leave: ""})
    if entry == leave:
        return DELETE * len(rows), "D" * len(rows)
    if (entry, leave) != (START, SYSTEM):
        return None
    options = [(DELETE * (len(rows) - 1) + (CUT_OFF if found else 0), "D" * i + "K" + "D" * (len(rows) - 1 - i))
               for i, (initial, found) in enumerate(rows) if initial == "s" and found in ("", "t")]
    return min(options, default=None)


def fold(costs: list[list[int]], ranks: list[list[int]]) -> tuple[int, list[int]]:
    """Cost and states before and behind every stretch on the least way. `costs` and `ranks` (of the edits among those with the same
    state before) have an entry for every pair of states. Edits of a stretch end with a row that is there, so that none of them
    begins another, and the first stretch in which two ways differ decides."""
    ahead = [INSERT * len(TAILS[s]) for s in STATES]
    chosen = []
    for cost, rank in zip(reversed(costs), reversed(ranks)):
        best = [min((cost[4 * s + t] + ahead[t], rank[4 * s + t], t) for t in STATES) for s in STATES]
        chosen.append([b[2] for b in best])
        ahead = [min(b[0], NEVER) for b in best]
    states = [START]
    for choice in reversed(chosen):
        states.append(choice[states[-1]])
    return ahead[START], states


def stretch_table(rows: list[tuple[str, str]]) -> tuple[list[int], list[int], list[str]]:
    """Cost, rank and edits for all pairs of states."""
    costs, ranks, edits = [], [], []
    for s in STATES:
        found = [between(rows, s, t) for t in STATES]
        order = sorted({f[1] for f in found if f})
        costs += [f[0] if f else NEVER for f in found]
        ranks += [order.index(f[1]) if f else len(order) for f in found]
        edits += [f[1] if f else "" for f in found]
    return costs, ranks, edits


def cheapest(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """The least (cost, edits) of a conversation."""
    if len(rows) <= WIDTH:
        return search(rows, START, TAILS)
    tables = [stretch_table(rows[i:i + WIDTH]) for i in range(0, len(rows), WIDTH)]
    cost, states = fold([t[0] for t in tables], [t[1] for t in tables])
    return cost, "".join(t[2][4 * s + e] for t, s, e in zip(tables, states, states[1:])) + TAILS[states[-1]]


def steps(edits: str, state: int, initials: list[str]) -> tuple[list[str], int]:
    """For every row what is written: u, a inserted rows, k the row itself, U, A the row with another role. Inserts behind the last
    row are one more entry."""
    out, place = [], 0
    for part in re.findall("I*[KRD]|I+$", edits):
        written = ""
        for edit in part:
            if edit == "I":
                state = AFTER[state]
                written += INITIALS[state]
            elif edit == "R":
                state = AFTER[state]
                written += INITIALS[state].upper()
            elif edit == "K":
                state = SYSTEM if state == START and initials[place] == "s" else AFTER[state]
                written += "k"
        place += 1
        out.append(written)
    return out, state


class Digest:
    """Hash of the lines `role:text`, fed row by row."""

    def __init__(self):
        self.hash, self.any = hashlib.sha256(), False

    def add(self, written: str, role: str, text: str) -> None:
        for what in written:
            line = {"u": "user:", "a": "assistant:", "U": f"user:{text}", "A": f"assistant:{text}"}.get(what, f"{role}:{text}")
            self.hash.update((f"\n{line}" if self.any else line).encode())
            self.any = True


# ---------------------------------------------------------------- Spark

def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after repeatable damage; `gone` marks rows that were dropped."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name("role").alias("role"),
        name("text").alias("text"), (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20).alias("how"))
    how = F.col("how")
    text = F.when(how.isin(0, 1), "").when(how == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(how == 4, "user").otherwise(F.col("role"))
    copies = F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (how == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PASS = (f"conv_id long, done struct<{COUNTS.replace(' ', ':').replace(',:', ', ')}>, piece int, pos long, turn long, role string, text string, "
        "fault string, mark binary")
EMPTY = hashlib.sha256(b"").hexdigest()


def gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _whole(turns: list, rows: list[tuple[str, str]]) -> dict:
    if not rows:
        return dict(gaps=0, blank=0, duplicate=0, truncated=0, illegal=0, cost=0, audit="", repaired_sha256=EMPTY)
    found, initials = faults(rows), [role[:1] for role, _ in rows]
    cost, edits = cheapest(list(zip(initials, found)))
    digest = Digest()
    for written, (role, text) in zip(steps(edits, START, initials)[0], [*rows, ("", "")]):
        digest.add(written, role, text)
    return dict(gaps=gaps(turns), blank=found.count("b"), duplicate=found.count("d"), truncated=found.count("t"),
                illegal=illegal(initials), cost=cost, audit=edits, repaired_sha256=digest.hash.hexdigest())


def _range_pass(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, done = this_piece(), []
        for key, table, whole in groups(batches):
            cols = [table.column(i).to_pylist() for i in range(1, 5)]
            live = [(turn, role, text) for turn, role, text, gone in zip(*cols) if not gone]
            if whole:
                done.append({"conv_id": key, "done": _whole([r[0] for r in live], [r[1:] for r in live])})
                if len(done) >= 1000:
                    yield from pa.Table.from_pylist(done, schema).to_batches()
                    done = []
                continue
            found = faults([r[1:] for r in live])
            rows = [{"conv_id": key, "piece": piece, "pos": i, "turn": turn, "role": role, "text": text, "fault": f,
                     "mark": hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()}
                    for i, ((turn, role, text), f) in enumerate(zip(live, found))]
            yield from pa.Table.from_pylist(rows or [{"conv_id": key, "piece": piece}], schema).to_batches(max_chunksize=2000)
        if done:
            yield from pa.Table.from_pylist(done, schema).to_batches()
    return run


def _stretch(table: pa.Table) -> pa.Table:
    """(conv_id, piece, stretch, pos, initial, fault) of one stretch to its row of costs, ranks, edits and counts."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("pos", "initial", "fault"))))
    initials, found = [r[1] for r in rows], [r[2] for r in rows]
    costs, ranks, edits = stretch_table(list(zip(initials, found)))
    return pa.Table.from_pylist([{
        "conv_id": table.column("conv_id")[0].as_py(), "piece": table.column("piece")[0].as_py(), "stretch": table.column("stretch")[0].as_py(),
        "first": rows[0][0], "costs": costs, "ranks": ranks, "edits": edits, "initials": "".join(f"{len(i)}{i}" for i in initials), "blank": found.count("b"), "duplicate": found.count("d"),
        "truncated": found.count("t"), "illegal": illegal(initials), "opens": initials[0], "ends": initials[-1]}], STRETCH_ARROW)


STRETCH = ("conv_id long, piece int, stretch long, first long, costs array<long>, ranks array<int>, edits array<string>, initials string, blank long, "
           "duplicate long, truncated long, illegal long, opens string, ends string")
STRETCH_ARROW = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("stretch", pa.int64()), ("first", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())),
                           ("edits", pa.list_(pa.string())), ("initials", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
                           ("illegal", pa.int64()), ("opens", pa.string()), ("ends", pa.string())])
WAY = "conv_id long, piece int, stretch long, entry int, leave int, last boolean, cost long, blank long, duplicate long, truncated long, illegal long"
WAY_ARROW = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("stretch", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_()),
                       ("cost", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64())])


def _way(table: pa.Table) -> pa.Table:
    """The stretches of one conversation, 32 numbers each, to the states between them; counts stand at the last."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["piece"], r["stretch"]))
    cost, states = fold([r["costs"] for r in rows], [r["ranks"] for r in rows])
    total = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += sum(a["ends"] + b["opens"] not in LEGAL for a, b in zip(rows, rows[1:]))
    out = [{"conv_id": r["conv_id"], "piece": r["piece"], "stretch": r["stretch"], "entry": s, "leave": t, "last": False}
           for r, s, t in zip(rows, states, states[1:])]
    out[-1].update(last=True, cost=cost, **total)
    return pa.Table.from_pylist(out, WAY_ARROW)


def _row_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, piece, first, entry, edits, initials) to a row for each row of the stretch."""
    schema = pa.schema([("s_conv", pa.int64()), ("s_piece", pa.int32()), ("s_pos", pa.int64()), ("edits", pa.string()), ("written", pa.string()), ("behind", pa.string())])
    for batch in batches:
        for row in batch.to_pylist():
            initials = [m.group(1) or "" for m in re.finditer(r"0|1(.)", row["initials"], re.S)]
            parts = re.findall("I*[KRD]|I+$", row["edits"])
            written, _ = steps(row["edits"], row["entry"], initials)
            n = len(initials)
            out = [{"s_conv": row["conv_id"], "s_piece": row["piece"], "s_pos": row["first"] + i, "edits": parts[i], "written": written[i], "behind": ""} for i in range(n)]
            if len(parts) > n:
                out[-1].update(edits=parts[n - 1] + parts[n], behind=written[n])
            yield from pa.Table.from_pylist(out, schema).to_batches()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order (conv_id, role, text, edits, written, behind) to one row per conversation; nothing but the edits is held."""
    schema = pa.schema([("h_conv", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    digest, edits, key, any_row = Digest(), [], None, False
    done = lambda: pa.RecordBatch.from_pylist([{"h_conv": key, "audit": "".join(edits), "repaired_sha256": digest.hash.hexdigest()}], schema)
    for batch in batches:
        for conv, role, text, some, written, behind in zip(*(c.to_pylist() for c in batch.columns)):
            if any_row and conv != key:
                yield done()
                digest, edits = Digest(), []
            key, any_row = conv, True
            digest.add(written, role, text)
            digest.add(behind, "", "")
            edits.append(some)
    if any_row:
        yield done()


def _cut_conversations(cut: DataFrame) -> DataFrame:
    """Conversations that lie in several ranges (or at the border of one)."""
    live = cut.where(F.col("pos").isNotNull())
    narrow = live.select("conv_id", "piece", "pos", F.substring("role", 1, 1).alias("initial"), "fault", "mark")
    # A piece knows its own repeats: of what is left a text occurs once in a piece at most.
    own, open_ = F.col("fault").isin("b", "d"), F.col("fault").isin("", "t")
    earlier = F.row_number().over(W.partitionBy("conv_id", "mark").orderBy("piece")) > 1
    judged = narrow.where(own).unionByName(narrow.where(open_).withColumn("fault", F.when(earlier, "d").otherwise(F.col("fault"))))
    stretch = F.floor(F.col("pos") / WIDTH).alias("stretch")
    tables = materialise(judged.select("conv_id", "piece", stretch, "pos", "initial", "fault")
                         .groupBy("conv_id", "piece", "stretch").applyInArrow(_stretch, STRETCH), "stretches")
    way = materialise(tables.drop("edits", "initials", "first").groupBy("conv_id").applyInArrow(_way, WAY), "ways")
    w = way.select(*(F.col(c).alias(f"w_{c}") for c in ("conv_id", "piece", "stretch", "entry", "leave", "last")))
    tails = F.element_at(F.array(*(F.lit(TAILS[s]) for s in STATES)), F.col("w_leave") + 1)
    chosen = (tables.join(w, same(F.col("conv_id"), F.col("w_conv_id")) & (F.col("piece") == F.col("w_piece")) & (F.col("stretch") == F.col("w_stretch")))
              .select("conv_id", "piece", "first", F.col("w_entry").alias("entry"), "initials",
                      F.concat(F.element_at("edits", 4 * F.col("w_entry") + F.col("w_leave") + 1), F.when(F.col("w_last"), tails).otherwise("")).alias("edits")))
    ops = chosen.mapInArrow(_row_steps, "s_conv long, s_piece int, s_pos long, edits string, written string, behind string")
    rows = live.join(ops, same(F.col("conv_id"), F.col("s_conv")) & (F.col("piece") == F.col("s_piece")) & (F.col("pos") == F.col("s_pos")))
    hashed = (rows.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "pos").select("conv_id", "role", "text", "edits", "written", "behind")
              .mapInArrow(_hashes, "h_conv long, audit string, repaired_sha256 string"))
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0))
    totals = way.where("last").select(F.col("conv_id").alias("t_conv"), "cost", "blank", "duplicate", "truncated", "illegal")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return (cut.groupBy("conv_id").agg(span.alias("gaps")).join(totals, same(F.col("conv_id"), F.col("t_conv")), "left")
            .join(hashed, same(F.col("conv_id"), F.col("h_conv")), "left")
            .select("conv_id", *(count(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                    F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256")))


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (not null) and `gone` to one row per conversation: faults, cost, edits and the digest of what is left."""
    wanted = rows.select("conv_id", "turn", "role", "text", "gone")
    keys = ["conv_id", "turn", "role", F.xxhash64("text")]
    schema = to_arrow_schema(StructType.fromDDL(PASS))
    passed = materialise(in_ranges(wanted, keys, F.octet_length("text") + 32).mapInArrow(_range_pass(schema), PASS), "repaired")
    whole = passed.where(F.col("done").isNotNull()).select("conv_id", "done.*")
    return whole.unionByName(_cut_conversations(passed.where(F.col("done").isNull())))
