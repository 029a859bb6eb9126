"""Chat documents rebuilt from event logs.

A log has rows (conv_id, seq, kind, message, role, text), ordered in a conversation by `seq` (any type that can be sorted; nulls
first):

    open        the message begins, with its role; the first one counts
    delta       text is added to the message
    edit        the message has this text instead
    regenerate  the message begins again without text, and all messages opened after it, up to this event, are withdrawn
    delete      the message is withdrawn

Events of a message before it was opened, and of other kinds, have no effect. What stands is written, in the order of opening, as
`### role: text</turn>` lines. A backslash inside a text is doubled, and one is put into `##` and `</turn>` (and `: ` in a role), so
that marks are found by plain search and every text can be read back. `loss` are the spans of assistant texts, in code points.

Conversations inside one range are folded where they lie; those at its borders, such as one with a third of all rows, are folded by
message with aggregates and windows, and come out as several parts that follow each other. Nulls: role and text are empty, conv_id
and message NULL are values like any other. Repeated events are events. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from typing import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from queuemill.llm.ranges import groups, in_ranges, same, this_piece
from queuemill.runtime import materialise

HEAD, NAMED, END = "### ", ": ", "</turn>\n"
LEARNT = "assistant"
CUT = "piece int, pos long, kind string, message long, role string, text string"
FORMATTED = "formatted string, loss array<struct<start: long, end: long>>"
DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


# ---------------------------------------------------------------- template

def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("##", "#\\#").replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """The document of (role, text) turns and the spans of assistant texts in it."""
    parts, loss, at = [], [], 0
    for role, text in turns:
        head, body = HEAD + escape(role).replace(NAMED, ":\\ ") + NAMED, escape(text)
        if role == LEARNT:
            loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), loss


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a document."""
    turns = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part[len(HEAD):].partition(NAMED)
        turns.append((unescape(role), unescape(text)))
    return turns


class Digest:
    """What a document says of itself, fed part by part."""

    def __init__(self):
        self.turns, self.loss, self.n_turns, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, formatted: str, loss: list[dict]) -> "Digest":
        for role, text in read_back(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for span in loss:
            text = unescape(formatted[span["start"]:span["end"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)
        return self

    def result(self) -> dict:
        return {"n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars,
                "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


# ---------------------------------------------------------------- fold

def fold(events: Iterator[tuple[str, int, str, str]]) -> list[tuple[str, str]]:
    """(kind, message, role, text) in order to the (role, text) of the messages that stand."""
    known: dict = {}
    standing: list = []
    for kind, message, role, text in events:
        if kind == "open":
            if message not in known:
                known[message] = entry = {"role": role or "", "parts": [], "place": len(known), "stands": True}
                standing.append(entry)
            continue
        entry = known.get(message)
        if entry is None:
            continue
        if kind == "delta":
            entry["parts"].append(text or "")
        elif kind == "edit":
            entry["parts"] = [text or ""]
        elif kind == "delete":
            entry["stands"] = False
        elif kind == "regenerate":
            entry["parts"] = []
            while standing and standing[-1]["place"] > entry["place"]:
                standing.pop()
    return [(e["role"], "".join(e["parts"])) for e in standing if e["stands"]]


def _plain(formatted: str, loss: list[dict]) -> dict:
    return {"formatted": formatted, "loss": loss}


def _digest(formatted: str, loss: list[dict]) -> dict:
    return Digest().add(formatted, loss).result()


def _range_pass(finish: Callable, schema: pa.Schema):
    """Events sorted by (conv_id, seq): a row for each conversation that is whole, the events themselves of the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, out, held = this_piece(), [], 0
        for key, table, whole in groups(batches):
            if whole:
                row = {"conv_id": key, "done": finish(*render(fold(zip(*(c.to_pylist() for c in table.columns[1:])))))}
                out.append(row)
                held += 1000 + len(row["done"].get("formatted", ""))
                if held >= 1 << 20:
                    yield from pa.Table.from_pylist(out, schema).to_batches()
                    out, held = [], 0
                continue
            n = table.num_rows
            rest = pa.table({"conv_id": table.column(0), "done": pa.nulls(n, schema.field("done").type), "piece": pa.array([piece] * n, pa.int32()),
                             "pos": pa.array(range(n), pa.int64()), **{name: table.column(i) for i, name in enumerate(("kind", "message", "role", "text"), 1)}})
            yield from rest.cast(schema).to_batches(max_chunksize=2000)
        if out:
            yield from pa.Table.from_pylist(out, schema).to_batches()
    return run


def _passed(log: DataFrame, finish: Callable, columns: str) -> DataFrame:
    ddl = f"conv_id long, done struct<{columns}>, {CUT}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    wanted = log.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("kind").cast("string").alias("kind"), F.col("message").cast("long").alias("message"),
                        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), "seq")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 48
    ranged = in_ranges(wanted, ["conv_id", "seq"], size).drop("seq")
    return materialise(ranged.mapInArrow(_range_pass(finish, schema), ddl), "chats")


def _messages(cut: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of the messages that stand in conversations cut by range borders."""
    at = F.struct("piece", "pos")
    key = lambda c: F.col(c)
    opened = (cut.where("kind = 'open'").groupBy("conv_id", "message").agg(F.min(F.struct("piece", "pos", "role")).alias("o"))
              .select(key("conv_id").alias("o_conv"), key("message").alias("o_message"), F.struct("o.piece", "o.pos").alias("place"), F.coalesce("o.role", F.lit("")).alias("role")))
    changes = (cut.where(F.col("kind").isin("edit", "regenerate", "delete")).groupBy("conv_id", "message")
               .agg(F.max(F.when(F.col("kind") != "delete", at)).alias("reset"), F.max(F.when(F.col("kind") == "delete", at)).alias("deleted"))
               .select(key("conv_id").alias("c_conv"), key("message").alias("c_message"), "reset", "deleted"))
    message = opened.join(changes, same(key("o_conv"), key("c_conv")) & same(key("o_message"), key("c_message")), "left").drop("c_conv", "c_message")
    # A message is withdrawn if some later regeneration concerns one opened before it: the least such, read backwards.
    again = (cut.where("kind = 'regenerate'").select(key("conv_id").alias("a_conv"), key("message").alias("a_message"), at.alias("a_at"))
             .join(opened, same(key("a_conv"), key("o_conv")) & same(key("a_message"), key("o_message"))).where(key("a_at") > key("place"))
             .select("a_conv", F.col("a_at.piece").alias("piece"), F.col("a_at.pos").alias("pos"), F.col("place").alias("target")))
    points = message.select(F.col("o_conv").alias("a_conv"), F.col("place.piece").alias("piece"), F.col("place.pos").alias("pos"), F.lit(None).cast("struct<piece: int, pos: long>").alias("target"),
                            "o_message", "role", "reset", "deleted")
    line = points.unionByName(again, allowMissingColumns=True)
    back = W.partitionBy("a_conv", "piece").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0)
    behind = W.partitionBy("a_conv").orderBy(F.desc("piece")).rowsBetween(W.unboundedPreceding, -1)
    carried = (line.groupBy("a_conv", "piece").agg(F.min("target").alias("least")).withColumn("later", F.min("least").over(behind))
               .select(key("a_conv").alias("l_conv"), key("piece").alias("l_piece"), "later"))
    own = F.struct("piece", "pos")
    stands = (line.withColumn("within", F.min("target").over(back)).where("target is null")
              .join(carried, same(key("a_conv"), key("l_conv")) & (key("piece") == key("l_piece")))
              .where(F.coalesce(F.least("within", "later") >= own, F.lit(True)) & F.coalesce(key("deleted") < own, F.lit(True)))
              .select("a_conv", "o_message", own.alias("place"), "role", F.when(key("reset") > own, key("reset")).otherwise(own).alias("since")))
    texts = (cut.where(F.col("kind").isin("delta", "edit"))
             .join(stands.select(key("a_conv").alias("s_conv"), key("o_message").alias("s_message"), "since"), same(key("conv_id"), key("s_conv")) & same(key("message"), key("s_message")))
             .where(at >= key("since")).groupBy("conv_id", "message")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "pos", F.coalesce("text", F.lit("")).alias("t")))), lambda p: p["t"]), "").alias("text")))
    return (stands.join(texts, same(key("a_conv"), key("conv_id")) & same(key("o_message"), key("message")), "left")
            .select(key("a_conv").alias("conv_id"), "place", stands["role"], F.coalesce("text", F.lit("")).alias("text")))


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            done = [render([turn]) for turn in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(SPAN))],
                                             names=["conv_id", "place", "formatted", "loss"])


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _parts(cut: DataFrame) -> DataFrame:
    return _messages(cut).select("conv_id", "place", "role", "text").mapInArrow(
        _rendered, f"conv_id long, place struct<piece: int, pos: long>, {FORMATTED}")


def format_logs(log: DataFrame) -> DataFrame:
    """(conv_id, place, formatted, loss): parts of a conversation, in the order of `place` (NULL: it has only this one)."""
    passed = _passed(log, _plain, FORMATTED)
    whole = passed.where(F.col("done").isNotNull()).select("conv_id", F.lit(None).cast("struct<piece: int, pos: long>").alias("place"), "done.*")
    return whole.unionByName(_parts(passed.where(F.col("done").isNull()).select("conv_id", "piece", "pos", "kind", "message", "role", "text")))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts (conv_id, formatted, loss) in order to one row per conversation, without holding them."""
    schema = pa.schema([("conv_id", pa.int64()), *((name, pa.string() if kind == "string" else pa.int64()) for name, kind in (c.split(" ") for c in DIGEST.split(", ")))])
    digest = key = None
    for batch in batches:
        for conv, formatted, loss in zip(*(c.to_pylist() for c in batch.columns)):
            if digest is not None and conv != key:
                yield pa.RecordBatch.from_pylist([{"conv_id": key, **digest.result()}], schema)
                digest = None
            key, digest = conv, (digest or Digest()).add(formatted, loss)
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": key, **digest.result()}], schema)


def digests(log: DataFrame) -> DataFrame:
    """Formats all conversations and reads the documents back: one row each, also of those without a standing message."""
    passed = _passed(log, _digest, DIGEST)
    whole = passed.where(F.col("done").isNotNull()).select("conv_id", "done.*")
    cut = passed.where(F.col("done").isNull()).select("conv_id", "piece", "pos", "kind", "message", "role", "text")
    parts = _parts(cut).repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "formatted", "loss")
    told = parts.mapInArrow(_in_order, f"conv_id long, {DIGEST}")
    nothing, names = Digest().result(), [c.split(" ")[0] for c in DIGEST.split(", ")]
    all_cut = cut.groupBy(F.col("conv_id").alias("k_conv")).agg(F.count(F.lit(1)).alias("events"))
    return whole.unionByName(all_cut.join(told, same(F.col("k_conv"), F.col("conv_id")), "left")
                             .select(F.col("k_conv").alias("conv_id"), *(F.coalesce(n, F.lit(nothing[n])).alias(n) for n in names)))


# ---------------------------------------------------------------- logs of finished conversations

def event_log(conversations: DataFrame) -> DataFrame:
    """A log that ends as the rows of `conversations`, in the order of turn (nulls first), role and text digest: texts arrive in
    pieces, and some turns were drafted, edited, or regenerated after somebody had gone on."""
    n = F.length("text")
    part = lambda a, b: F.substring(F.col("text"), F.floor(n * a).cast("int") + 1, F.floor(n * b).cast("int") - F.floor(n * a).cast("int"))
    draft = F.concat(F.substring("text", 1, 40), F.lit(" ## draft"))
    event = lambda kind, text=None, message=None: F.struct(
        F.lit(kind).alias("kind"), (F.col("message") if message is None else message).alias("message"),
        (F.col("role") if kind == "open" else F.lit(None).cast("string")).alias("role"), (F.lit(None).cast("string") if text is None else text).alias("text"))
    other = -1 - F.col("message")
    ways = [
        [event("open"), event("delta", part(0, 1 / 3)), event("delta", part(1 / 3, 2 / 3)), event("delta", part(2 / 3, 1))],
        [event("open"), event("delta", draft), event("regenerate"), event("delta", part(0, 0.5)), event("delta", part(0.5, 1))],
        [event("open"), event("delta", draft), event("edit", F.col("text"))],
        [event("open"), event("delta", draft), event("open", message=other), event("delta", F.lit("never mind"), other), event("regenerate"),
         event("delta", part(0, 0.5)), event("delta", part(0.5, 1))],
        [event("open"), event("delta", F.col("text"))],
    ]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                                F.monotonically_increasing_id().alias("message"))
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(len(ways)))
    events = F.when(way == 0, F.array(*ways[0]))
    for i, some in enumerate(ways[1:], 1):
        events = events.when(way == i, F.array(*some))
    first = F.struct("turn", F.col("role").alias("by"), F.xxhash64("text").alias("digest"), F.col("message").alias("row"))
    return (rows.select("conv_id", first.alias("first"), F.posexplode(events).alias("step", "event"))
            .select("conv_id", F.struct("first", "step").alias("seq"), "event.*"))
