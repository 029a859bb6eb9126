"""Hard negatives for contrastive training, exact, from lists that clusters of anchors share.

For every anchor the best rows of its own label are its positives; for every positive the best rows of other labels whose score lies
between two shares of the positive's score are its negatives. Scores are inner products of whole numbers.

Anchors are grouped by the direction of their vectors (spherical k-means on at most SAMPLE of them, which decides speed only). If a
row lies at angle a from the centre of a cluster whose anchors lie within angle b, no anchor of it can score more with the row than
|anchor| * |row| * cos(max(0, a - b)). For each cluster a task sorts its rows by that bound once; all anchors of the cluster walk the
list together, tile by tile, and an anchor stops when its bound falls below what it still needs: its worst kept score, or the lower
edge of its bands. Rows are dealt out in chunks of CHUNK and anchors in packs of PACK components, whole clusters where they fit, so
memory is bounded and copies or a frequent label are just more chunks. The best of all chunks meet in a ranked merge.

Rows with a null id, label or vector, or a component that is null or not finite (also after the multiplication), take no part. Rows are told apart by vec_id: a row with the
anchor's own id is never its positive; an anchor row that repeats exactly counts once, other repeats are rows. Missing components of
shorter vectors count as zero. Ties go to the smaller vec_id. Scores beyond a long are returned as its nearest value. Other columns
are not looked at.
"""

from __future__ import annotations

import math
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuemill.runtime import materialise

SAMPLE = 4096       # anchors the cluster centres are fitted on
CHUNK = 1 << 22     # components of the rows a task holds
PACK = 1 << 18      # components of the anchors a task holds
LEAST = 1024        # rows below which a chunk isn't cut finer
MEMBERS = 64        # anchors a cluster has on average
TILE = 512          # rows multiplied at a time
ROUNDS = 5          # of k-means
SLACK = 1e-6        # relative; above rounding of norms, angles and cosines
EXACT = 1 << 53     # sums below this are exact in doubles
LONG = (1 << 63) - 1

ROWS = "vec_id long, label long, vector binary, wide boolean"
ROW_NAMES = ("vec_id", "label", "vector", "wide")
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


# ---------------------------------------------------------------- vectors

def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, list of doubles) to rows with floor(256 x) as 16-bit numbers, or doubles where one does not fit."""
    for batch in batches:
        ids, labels, lists = batch.columns
        offsets = lists.offsets.to_numpy()
        flat = lists.values
        values = np.asarray(flat.to_numpy(zero_copy_only=False), float)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        whole = np.isfinite(values)
        with np.errstate(over="ignore"):
            values = np.floor(256 * values)
        whole &= np.isfinite(values)
        keep, vectors, wide = [], [], []
        for i, (low, high) in enumerate(zip(offsets, offsets[1:])):
            if not lists[i].is_valid or not whole[low:high].all():
                continue
            row = values[low:high]
            big = bool(high > low and np.abs(row).max() > 32767)
            keep.append(i)
            wide.append(big)
            vectors.append(row.astype("<f8" if big else "<i2").tobytes())
        at = pa.array(keep, pa.int32())
        yield pa.RecordBatch.from_arrays([ids.take(at), labels.take(at), pa.array(vectors, pa.binary()), pa.array(wide, pa.bool_())],
                                         names=["vec_id", "label", "vector", "wide"])


def matrix(vectors: list[bytes], wide: list[bool], width: int = 0) -> np.ndarray:
    """Rows as doubles, padded with zeros to the longest (or `width`)."""
    rows = [np.frombuffer(v, "<f8" if w else "<i2") for v, w in zip(vectors, wide)]
    width = max([width, *(len(r) for r in rows)])
    if rows and not any(wide) and all(len(r) == width for r in rows):
        return np.frombuffer(b"".join(vectors), "<i2").reshape(len(rows), width).astype(float)
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left @ right.T without rounding: in doubles where no sum can exceed 2^53, else in whole numbers of any size."""
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)))
    if np.abs(left).max() * np.abs(right).max() * left.shape[1] < EXACT:
        return left @ right.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return np.clip(whole(left) @ whole(right).T, -LONG - 1, LONG)


def angles(left: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Angles between rows and unit vectors; a zero row is at 0 from all."""
    scale = np.maximum(np.abs(left).max(axis=1, initial=1.0), 1.0)[:, None]
    norms = np.linalg.norm(left / scale, axis=1)
    cosines = np.clip((left / scale) @ unit.T / np.maximum(norms, 1e-300)[:, None], -1, 1)
    return np.where((norms > 0)[:, None], np.arccos(cosines), 0.0)


def norms(m: np.ndarray) -> np.ndarray:
    scale = np.maximum(np.abs(m).max(axis=1, initial=1.0), 1.0)
    return scale * np.linalg.norm(m / scale[:, None], axis=1)


# ---------------------------------------------------------------- clusters

def centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit centres of spherical k-means; the first are spread over the sample."""
    unit = sample / np.maximum(norms(sample), 1e-300)[:, None]
    unit = unit[norms(sample) > 0]
    if not len(unit):
        return np.zeros((1, sample.shape[1]))
    found = unit[np.linspace(0, len(unit) - 1, min(count, len(unit))).astype(int)]
    for _ in range(ROUNDS):
        nearest = (unit @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, unit)
        size = np.linalg.norm(sums, axis=1)
        found = np.where((size > 0)[:, None], sums / np.maximum(size, 1e-300)[:, None], found)
    return found


def _placed(found: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column("vector").to_pylist(), batch.column("wide").to_pylist(), found.shape[1])[:, :found.shape[1]]
            nearest = angles(m, found).argmin(axis=1) if batch.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32))], names=[*batch.schema.names, "cluster"])
    return run


# ---------------------------------------------------------------- the walk

def walk(anchors: np.ndarray, centre: np.ndarray, rows: np.ndarray, ids: np.ndarray, wants: Callable, offer: Callable) -> int:
    """Walks the list of `rows` shared by the anchors of one cluster. `offer(members, part, scores)` takes the scores of some anchors
    with some rows; `wants(members)` tells the least score each of them can still use (-inf: any). Returns how many pairs were scored."""
    lengths, sizes = norms(anchors), norms(rows)
    reach = angles(anchors, centre[None, :])[:, 0].max()
    spread = angles(rows, centre[None, :])[:, 0]
    upper = sizes * np.cos(np.maximum(spread - reach, 0.0))
    order = np.lexsort((ids, -upper))
    best, scored = upper[order] + SLACK * sizes.max(initial=1.0), 0
    active = np.arange(len(anchors))
    for at in range(0, len(order), TILE):
        with np.errstate(invalid="ignore", over="ignore"):
            active = active[~(lengths[active] * best[at] < wants(active))]      # overflow stops nobody
        if not len(active):
            break
        part = order[at:at + TILE]
        offer(active, part, products(anchors[active], rows[part]))
        scored += len(active) * len(part)
    return scored


class Best:
    """The k best (score, -id) of each of n lists; scores stay exact."""

    def __init__(self, n: int, k: int):
        self.k, self.held = k, [[] for _ in range(n)]

    def worst(self, i: int) -> float:
        return self.held[i][-1][0] if len(self.held[i]) == self.k else -math.inf

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k and scores.dtype != object:
            some = np.flatnonzero(scores >= np.partition(scores, -self.k)[-self.k])
            some = some[np.lexsort((ids[some], -scores[some]))][:self.k]       # equal scores at the edge: the smaller ids
            scores, ids = scores[some], ids[some]
        merged = self.held[i] + [(int(s), int(d)) for s, d in zip(scores, ids)]
        self.held[i] = sorted(merged, key=lambda p: (-p[0], p[1]))[:self.k]


def _clusters(table: pa.Table, found: np.ndarray):
    """(centre, rows of the table) of every cluster of a pack."""
    cluster = table.column("a_cluster").to_numpy()
    for c in np.unique(cluster):
        yield found[c], np.flatnonzero(cluster == c)


def _both(anchors: pa.Table, rows: pa.Table, found: np.ndarray):
    wide = lambda t, c: matrix(t.column(f"{c}_vector").to_pylist(), t.column(f"{c}_wide").to_pylist(), found.shape[1])
    left, right = wide(anchors, "a"), wide(rows, "r")
    width = max(left.shape[1], right.shape[1])
    pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    return pad(left), pad(right), np.pad(found, ((0, 0), (0, width - found.shape[1])))


LONGS = lambda *names: pa.schema([(n, pa.int64()) for n in names])
POSITIVE = LONGS("key", "positive_id", "positive_score")
NEGATIVE = pa.schema([("key", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int32()),
                      *LONGS("positive_id", "positive_score", "negative_id", "negative_score")])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _positives(k: int, found: np.ndarray):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return POSITIVE.empty_table()
        left, right, middle = _both(anchors, rows, found)
        ids, labels = rows.column("r_id").to_numpy(), rows.column("r_label").to_numpy()
        own, label = anchors.column("a_id").to_numpy(), anchors.column("a_label").to_numpy()
        best = Best(len(own), k)
        for centre, members in _clusters(anchors, middle):
            # Only rows of a label that an anchor of the cluster has can be positives.
            usable = np.flatnonzero(np.isin(labels, label[members]))

            def offer(active, part, scores):
                for i, row in zip(members[active], scores):
                    good = (labels[usable[part]] == label[i]) & (ids[usable[part]] != own[i])
                    if good.any():
                        best.add(i, row[good], ids[usable[part]][good])

            walk(left[members], centre, right[usable], ids[usable], lambda active: np.array([float(best.worst(i)) for i in members[active]]), offer)
        key = anchors.column("a_key").to_numpy()
        return _table([(key[i], d, s) for i, held in enumerate(best.held) for s, d in held], POSITIVE)
    return run


def _negatives(k: int, low: int, high: int, found: np.ndarray):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return NEGATIVE.empty_table()
        left, right, middle = _both(anchors, rows, found)
        ids, labels = rows.column("r_id").to_numpy(), rows.column("r_label").to_numpy()
        label, positives = anchors.column("a_label").to_numpy(), anchors.column("a_positives").to_pylist()
        bands = [[(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in some] for some in positives]
        start = np.cumsum([0, *map(len, bands)])
        best = Best(int(start[-1]), k)

        def need(i):
            # A band is done when it is full and nothing better can come; nothing below its lower edge counts.
            return min((max(float(a), best.worst(start[i] + j)) for j, (a, b) in enumerate(bands[i]) if a <= b), default=math.inf)

        for centre, members in _clusters(anchors, middle):
            def offer(active, part, scores):
                for i, row in zip(members[active], scores):
                    other = labels[part] != label[i]
                    for j, (a, b) in enumerate(bands[i]):
                        floor = max(a, best.worst(start[i] + j))
                        good = np.flatnonzero(other & (row <= b) & (row >= floor))
                        if len(good):
                            best.add(start[i] + j, row[good], ids[part[good]])

            walk(left[members], centre, right, ids, lambda active: np.array([float(need(i)) for i in members[active]]), offer)
        key, own = anchors.column("a_key").to_numpy(), anchors.column("a_id").to_numpy()
        return _table([(key[i], own[i], p["place"], p["positive_id"], p["positive_score"], d, s)
                       for i, some in enumerate(positives) for j, p in enumerate(some) for s, d in best.held[start[i] + j]], NEGATIVE)
    return run


# ---------------------------------------------------------------- Spark

def whole_vectors(embeddings: DataFrame, label: Column | None = None) -> DataFrame:
    """The rows that take part: vec_id, label (or what `label` makes of it) and floor(256 x) of every component, packed."""
    picked = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"),
                               F.col("embedding").cast("array<double>").alias("vector"))
    return picked.where("vec_id is not null and label is not null and vector is not null").mapInArrow(_pack, ROWS)


def _in_packs(anchors: DataFrame, found: np.ndarray, most: int) -> tuple[DataFrame, int]:
    """Anchors with their cluster and pack, and the number of packs. A large cluster has packs of its own, small ones share."""
    placed = materialise(anchors.mapInArrow(_placed(found), f"a_key long, {ROWS}, cluster int"), "anchor-clusters")
    sizes = placed.groupBy("cluster").count().orderBy("cluster").collect()     # at most as many as there are centres
    first, parts, pack, filled = [], [], 0, 0
    for row in sizes:
        if filled and filled + row["count"] > most:
            pack, filled = pack + 1, 0
        pieces = math.ceil(row["count"] / most)
        first.append(pack)
        parts.append(pieces)
        filled += row["count"]
        if pieces > 1:
            pack, filled = pack + pieces, 0
    where = anchors.sparkSession.createDataFrame([(r["cluster"], f, n) for r, f, n in zip(sizes, first, parts)], "p_cluster int, first int, parts int")
    number = (F.col("first") + F.pmod(F.xxhash64("a_key"), F.col("parts"))).cast("int")
    return placed.join(F.broadcast(where), F.col("cluster") == F.col("p_cluster")).select("a_key", *ROW_NAMES, "cluster", number.alias("a_pack")), pack + 1


def _meet(anchors: DataFrame, rows: DataFrame, chunks: int, packs: int, run: Callable, schema: str) -> DataFrame:
    """Every pack of anchors meets every chunk of rows in a task of its own; chunks are even whatever the rows hold."""
    left = anchors.withColumn("a_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = rows.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int").alias("r_chunk"),
                        *(F.col(c).alias(n) for c, n in zip(ROW_NAMES, ("r_id", "r_label", "r_vector", "r_wide"))))
    right = right.withColumn("r_pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
    return left.groupBy("a_chunk", "a_pack").cogroup(right.groupBy("r_chunk", "r_pack")).applyInArrow(run, schema)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of `whole_vectors` that `anchor` picks."""
    spark = rows.sparkSession
    rows = materialise(rows, "vectors")
    asked = materialise(rows.where(anchor).distinct(), "anchors").withColumn("a_key", F.monotonically_increasing_id()).select("a_key", *ROW_NAMES)
    asked = materialise(asked, "anchor-keys")
    n_rows, n_asked = rows.count(), asked.count()
    if not n_asked:
        return spark.createDataFrame([], RESULT)
    some = asked.orderBy(F.xxhash64("vec_id", "a_key")).limit(SAMPLE).select("vector", "wide").collect()
    found = centres(matrix([bytes(r.vector) for r in some], [r.wide for r in some], 1), min(max(1, n_asked // MEMBERS), SAMPLE // 4))
    width = found.shape[1]
    placed, packs = _in_packs(asked, found, max(1, PACK // width))
    # Small tables are cut finer, so that every core has a chunk.
    chunks = max(math.ceil(n_rows / max(1, CHUNK // width)), min(2 * spark.sparkContext.defaultParallelism, math.ceil(n_rows / LEAST)))
    placed = placed.select("a_key", *(F.col(c).alias(n) for c, n in zip(ROW_NAMES, ("a_id", "a_label", "a_vector", "a_wide"))), F.col("cluster").alias("a_cluster"), "a_pack")

    partial = _meet(placed, rows, chunks, packs, _positives(positives, found), "key long, positive_id long, positive_score long")
    place = F.row_number().over(W.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id"))
    best = (partial.withColumn("place", place).where(F.col("place") <= positives).groupBy("key")
            .agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("a_positives")))
    paired = materialise(placed.join(best, F.col("a_key") == F.col("key")).drop("key"), "positives")

    partial = _meet(paired, rows, chunks, packs, _negatives(negatives, low, high, found),
                    "key long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(W.partitionBy("key", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return (partial.withColumn("rank", rank).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
