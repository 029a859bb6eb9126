"""Benchmark decontamination by template canonicalisation.

Documents and benchmark items become tokens of three kinds with a placeholder each: numbers, units (after a number) and
names (capitalised inside a sentence); all others are plain, A to Z lower-cased. In scripts without spaces every character is a
token. Windows of WIDTH tokens are hashed as templates, the first token of a window always as a plain one (where a passage was cut
in, the case of its first word says nothing), and in plain form, without placeholders, and joined by hash. All windows of a text
that hit one item along one diagonal are a match, and those of them that overlap a run. In a run one value of the item always stands
against one value of the document, so that a question with other numbers and names is found and a chance hit isn't; of a run
that contradicts itself the windows count in which every value is the same. The match is `exact` if all values are.

An item shorter than a window is one window of its length. A template window needs PLAIN plain tokens (or all of a shorter
one's but two) and SHORTEST tokens; everything else is found in plain form only. Items under LEAST tokens aren't looked for.
Null and empty texts match nothing; repeated rows and rows that share a document id count under that id; rows with a null id are
matched and carry null. Extra columns are left out.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuemill.llm.wordcodes import U, chunks, mix, run_hashes, text_bytes
from queuemill.runtime import materialise

WIDTH, PLAIN, SHORTEST, LEAST = 12, 6, 5, 3
#: Windows of a benchmark (or digests of matched texts) that may be sent to the tasks; more are joined by a shuffle.
SENT_WINDOWS = 2_000_000
UNITS = """mm cm m km in ft yd mi mile miles inch inches foot feet meter meters metre metres g kg mg lb lbs oz ton tons gram grams
s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years
l ml liter liters litre litres gallon gallons percent dollar dollars euro euros pound pounds cent cents usd eur gbp
degree degrees kmh mph w kw kwh v volt volts hz mb gb tb""".split()
WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3
FOUND = "id long, row long, hash long, at int, slots array<string>, tokens int"


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    step = np.searchsorted(starts, np.arange(0, len(data), 500_000)).tolist() + [len(starts)]
    return np.concatenate([np.zeros(0, U)] + [
        run_hashes(data[starts[a]:ends[b - 1]].astype(U), starts[a:b] - starts[a], ends[a:b] - starts[a:b])
        for a, b in zip(step, step[1:]) if a < b])


def _unit_hashes() -> np.ndarray:
    raw = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    sizes = np.array([len(u) for u in UNITS])
    starts = np.cumsum(sizes + 1) - sizes - 1
    return np.sort(_hash_words(raw, starts, starts + sizes))


def characters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of scripts without spaces (Chinese, Japanese, Thai, Lao, Burmese, Khmer): places before and behind each character; and which bytes are CJK or full-width punctuation."""
    after = np.append(raw[1:], np.zeros(1, np.uint8))
    third = np.append(raw[2:], np.zeros(2, np.uint8))[:len(raw)]
    between = lambda x, low, high: (x >= low) & (x <= high)
    mark = ((raw == 0xE3) & (after == 0x80) & (third != 0x85)
            | (raw == 0xEF) & ((after == 0xBC) & (between(third, 0x81, 0x8F) | between(third, 0x9A, 0xA0) | (third >= 0xBB)) | (after == 0xBD) & between(third, 0x9B, 0xA5)))
    three = (between(raw, 0xE3, 0xE9) | (raw == 0xE0) & between(after, 0xB8, 0xBB)
             | (raw == 0xE1) & (between(after, 0x80, 0x82) | between(after, 0x9E, 0x9F)))
    three, four = np.flatnonzero(three), np.flatnonzero((raw == 0xF0) & between(after, 0xA0, 0xB2))
    marks = np.flatnonzero(mark)
    return np.concatenate([three, three + 3, four, four + 4]), np.concatenate([marks, marks + 1, marks + 2])


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Row, plain digest, kind and byte bounds of every token."""
    raw, offsets = text_bytes(texts)
    digit = (raw >= 48) & (raw <= 57)
    upper = (raw >= 65) & (raw <= 90)
    inside = digit | upper | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    if len(raw) > 2:     # a point or comma between digits belongs to the number
        inside[1:-1] |= ((raw[1:-1] == 46) | (raw[1:-1] == 44)) & digit[:-2] & digit[2:]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    if len(raw) and raw.max() >= 0xE0:
        cuts, marks = characters(raw)
        edge[cuts] = True
        inside[marks] = False
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    bounds = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    plain = _hash_words(np.where(upper, raw + 32, raw).astype(np.uint8), starts, ends)
    kind = np.zeros(len(starts), np.int8)
    kind[digit[starts]] = NUMBER
    known = _unit_hashes()
    kind[1:][(kind[:-1] == NUMBER) & (kind[1:] == WORD) & (row[1:] == row[:-1])
             & (known[np.minimum(np.searchsorted(known, plain[1:]), len(known) - 1)] == plain[1:])] = UNIT
    # A capital after a full stop, colon, question or exclamation mark, line end or at the start opens a sentence.
    breaks = np.append(0, np.cumsum((raw == 46) | (raw == 33) | (raw == 63) | (raw == 58) | (raw == 10)))
    opens = np.ones(len(starts), bool)
    opens[1:] = (row[1:] != row[:-1]) | (breaks[starts[1:]] != breaks[ends[:-1]])
    kind[upper[starts] & ~opens & (kind == WORD)] = NAME
    return row, plain, kind, starts, ends, raw


def windows_of(row: np.ndarray, plain: np.ndarray, kind: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, digest, and if it is a template: all windows with enough plain tokens as templates, and all in plain form unless that is the same."""
    if len(row) < width:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, bool)
    at = np.flatnonzero(row[:len(row) - width + 1] == row[width - 1:])
    words = np.append(0, np.cumsum(kind == WORD))
    # The first token counts as plain, whatever it looks like.
    count = words[at + width] - words[at + 1] + 1
    enough = (count >= min(PLAIN, width - 2)) & (width >= SHORTEST)
    form = np.where(kind == WORD, plain, mix(kind.astype(U) + U(77)))
    forms = [(at[enough], form), (at[~enough | (count < width)], plain)]
    digest = [mix(run_hashes(values, a + 1, np.full(len(a), width - 1)) + plain[a] * U(0x9FB21C651E98DF25)) for a, values in forms]
    return np.concatenate([a for a, _ in forms]), np.concatenate(digest), np.repeat([True, False], [len(a) for a, _ in forms])


def _windows(batches: Iterator[pa.RecordBatch], widths: list[int], wanted: np.ndarray | None, whole: bool) -> Iterator[pa.RecordBatch]:
    """(id, text, row) to the windows: of all widths, or (`whole`) of a text's own length if that is less than WIDTH."""
    for batch in batches:
        for part in chunks(batch, 1):
            row, plain, kind, starts, ends, raw = tokens_of(part.column(1))
            count = np.bincount(row, minlength=part.num_rows)
            first = np.cumsum(count) - count
            ids, rows = part.column(0).to_pylist(), part.column(2).to_pylist()
            out: list[tuple] = []
            for width in widths:
                at, digest, template = windows_of(row, plain, kind, width)
                if whole:
                    keep = (width == WIDTH) | (count[row[at]] == width)
                else:
                    keep = np.ones(len(at), bool)
                if wanted is not None and len(wanted):
                    keep &= wanted[np.minimum(np.searchsorted(wanted, digest), len(wanted) - 1)] == digest
                elif wanted is not None:
                    keep[:] = False
                for a, h, t in zip(at[keep].tolist(), digest[keep].view(np.int64).tolist(), template[keep].tolist()):
                    slots = [f"{k - a}:{bytes(raw[starts[k]:ends[k]]).decode('utf-8', 'replace')}"
                             for k in range(a + 1, a + width) if kind[k] != WORD] if t else []
                    r = int(row[a])
                    out.append((ids[r], rows[r], h, a - int(first[r]), slots, width))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32()))],
                names=["id", "row", "hash", "at", "slots", "tokens"])


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, n_tokens and exact: every match of a document with a benchmark item."""
    spark = docs.sparkSession
    widths = list(range(LEAST, WIDTH + 1))
    items = (benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text"))
             .mapInArrow(lambda b: _windows(b, widths, None, True), FOUND))
    sizes = items.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()       # one row per width
    used = sorted({WIDTH, *(r["tokens"] for r in sizes)})
    wanted = None
    if sum(r["n"] for r in sizes) <= SENT_WINDOWS:
        hashes = np.unique(np.array([r["hash"] for r in items.select("hash").distinct().collect()], np.int64).view(U))
        wanted = spark.sparkContext.broadcast(hashes)
    found = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text"))
             .mapInArrow(lambda b: _windows(b, used, wanted.value if wanted else None, False), FOUND))
    theirs = items.select("hash", F.col("id").alias("item_id"), F.col("row").alias("_item"), F.col("at").alias("_at"),
                          F.col("slots").alias("_slots"), F.col("tokens").alias("_width"))
    # The place inside the window says which slots stand against each other; without it they are values.
    value = lambda c: F.substring_index(c, ":", -1)
    pairs = (found.join(F.broadcast(theirs) if wanted else theirs, "hash").where("tokens = _width AND size(slots) = size(_slots)")
             .select(F.col("id").alias("doc_id"), F.col("row").alias("_row"), "item_id", "_item", (F.col("at") - F.col("_at")).alias("_diagonal"), "_at", "tokens",
                     F.zip_with("_slots", "slots", lambda a, b: F.struct(value(a).alias("item"), value(b).alias("doc"))).alias("_values"))
             .withColumn("_same", F.forall("_values", lambda v: v["item"] == v["doc"])))
    # Texts that share an id are matched one by one. A window may be hit as a template and in plain form.
    text_pair = ["doc_id", "_row", "item_id", "_item", "_diagonal"]
    windows = pairs.groupBy(*text_pair, "_at", "tokens").agg(F.max("_same").alias("_same"), F.max("_values").alias("_values"))
    # A run ends where no window reaches over; between two windows of a run those may lack that begin with a changed slot.
    stop, along = F.col("_at") + F.col("tokens"), W.partitionBy(*text_pair).orderBy("_at")
    begins = F.when(F.col("_at") < F.lag(stop).over(along), 0).otherwise(1)
    runs = windows.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(along)).groupBy(*text_pair, "_run").agg(
        F.array_distinct(F.flatten(F.collect_list("_values"))).alias("_values"), F.min("_same").alias("_same"),
        *[F.struct(F.count(one).alias("n"), F.min(F.when(one.isNotNull(), F.col("_at"))).alias("first"), F.max(F.when(one.isNotNull(), stop)).alias("stop")).alias(name)
          for name, one in (("_all", F.lit(1)), ("_equal", F.when(F.col("_same"), 1)))])
    consistent = F.size(F.array_distinct(F.col("_values.item"))) == F.size("_values")
    match = (runs.withColumn("_hit", F.when(consistent, F.col("_all")).otherwise(F.col("_equal"))).groupBy(*text_pair)
             .agg(F.sum("_hit.n").alias("n_windows"), (F.max("_hit.stop") - F.min("_hit.first")).alias("n_tokens"), F.min("_same").alias("exact")))
    return (match.where("n_windows > 0").groupBy("doc_id", "item_id")
            .agg(F.max("n_windows").cast("long").alias("n_windows"), F.max("n_tokens").cast("long").alias("n_tokens"), F.max("exact").alias("exact")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that match no item. Texts are told apart by their digest, whatever their ids are."""
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    hits = materialise(contaminations(texts, benchmark).select(F.col("doc_id").alias("_hit")).distinct(), "contaminated")
    hits = F.broadcast(hits) if hits.count() <= SENT_WINDOWS else hits
    rows = docs.select(F.struct(*docs.columns).alias("_doc"))       # so that no name can clash
    return rows.join(hits, F.xxhash64("_doc.text") == F.col("_hit"), "left_anti").select("_doc.*")
