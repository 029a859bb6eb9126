"""Exact n-gram Jaccard join with a prefix tree, and the groups that its links make.

A document's set holds its distinct runs of N words. Two sets link when 100 * shared >= PERCENT * united.

1. Equal sets are one set, named by its digest.
2. Candidates. All sets share one order of n-grams: a fixed slice of the digests first, then rare before frequent. Sets that
   link share an n-gram among their first n - ceil(PERCENT * n / 100) + 1 ones. The slice is wide enough to hold these for
   most sets; only its n-grams are counted over the corpus (a set that has too few of them counts all of its n-grams). An
   n-gram that one set alone has links nothing, so most documents drop out here, and a passage in many documents
   comes late in the order and brings no candidates unless it fills a document.
3. Sets connected through such n-grams meet in one task. There a prefix tree stores them, frequent n-grams first, so that
   near copies share long paths; a set walks down the tree carrying its overlap, to sets of a like size that share one of its rarest
   n-grams (counted in the task, so that what is in most texts of the group brings nobody together), leaves a subtree when the rest
   of its own n-grams or of the subtree's sets can't reach the bound, and when all such sets below are in its group already.
   Large groups are cut into blocks and every two blocks meet in a task, so that no task is unbounded.

Texts without words (and nulls) have an empty set and link with nothing; fewer than N words make one n-gram. Rows with the
same document id count as one document with several texts. A null id sorts first, as one document. Sets are compared by
64-bit digests of their n-grams. Extra columns are left out; empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuemill.llm.components import components
from queuemill.llm.wordcodes import U, chunks, mix, pack, ranges, run_hashes, unpack, words_of
from queuemill.runtime import materialise

#: The slice: digests below this share of all.
SLICE = 0.3
#: n-grams in one task of the tree join, at most; a group of more than SMALL_BLOCK is cut into up to COPIES blocks, to be joined side by side.
BLOCK, SMALL_BLOCK, COPIES = 6_000_000, 500_000, 16
NO_ID = -(1 << 63)
PACKED = "bucket int, blob binary"


def ngram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of every text as (row, digest), sorted, and the size of each row's set."""
    words = words_of(texts, lower=True)
    count = np.where(words.counts >= n, words.counts - n + 1, np.minimum(words.counts, 1))
    size = np.minimum(words.counts, n)
    row = np.repeat(np.arange(len(texts)), count)
    at = np.repeat(words.first - (np.cumsum(count) - count), count) + np.arange(len(row))
    grams = run_hashes(words.hashes, at, size[row])
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    new = np.append(True, (row[1:] != row[:-1]) | (grams[1:] != grams[:-1]))[:len(row)]
    row, grams = row[new], grams[new]
    return row, grams, np.bincount(row, minlength=len(texts))


def set_names(row: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A digest of each set; 0 for an empty one."""
    names = np.zeros(len(sizes), U)
    full = np.flatnonzero(sizes)
    if len(full):
        names[full] = mix(np.add.reduceat(mix(grams), (np.cumsum(sizes) - sizes)[full], dtype=U) + sizes[full].astype(U))
    return names.view(np.int64)


def prefix_sizes(sizes: np.ndarray, percent: int) -> np.ndarray:
    return sizes - (percent * sizes + 99) // 100 + 1


def packed_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])


def by_bucket(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The entries of each bucket."""
    if len(to):
        order = np.argsort(to, kind="stable")
        for one in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
            yield int(to[one[0]]), one


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(values.view(U)) % U(buckets)).astype(np.int64)


def _read(batches: Iterator[pa.RecordBatch], n: int, percent: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Documents to one row each, and to packed n-grams by bucket of the n-gram."""
    edge = U(int(SLICE * 2.0 ** 64))
    for batch in batches:
        for part in chunks(batch, 1):
            row, grams, sizes = ngram_sets(part.column(1), n)
            names = set_names(row, grams, sizes)
            inside = grams < edge
            in_slice = np.bincount(row[inside], minlength=len(sizes))
            whole = in_slice < prefix_sizes(sizes, percent)
            # Of equal sets in this piece one speaks for all.
            speaks = np.zeros(len(sizes), bool)
            speaks[np.unique(names, return_index=True)[1]] = True
            send = np.flatnonzero(speaks[row] & (inside | whole[row]))
            rest = np.where(whole, sizes - in_slice, 0)
            out = []
            for to, one in by_bucket(_bucket(grams[send], buckets)):
                known, code = np.unique(row[send[one]], return_inverse=True)
                out.append((to, pack(names[known], sizes[known], in_slice[known], rest[known], grams[send[one]], code.astype(np.int64))))
            docs = len(sizes)
            yield pa.RecordBatch.from_arrays([
                pa.array([0] * docs + [1] * len(out), pa.int32()),
                pa.concat_arrays([part.column(0).cast(pa.int64()), pa.nulls(len(out), pa.int64())]),
                pa.array(np.append(names, np.zeros(len(out), np.int64))), pa.array(np.append(sizes, np.zeros(len(out), np.int64))),
                pa.array([None] * docs + [x[0] for x in out], pa.int32()), pa.array([None] * docs + [x[1] for x in out], pa.binary())],
                names=["kind", "doc_id", "name", "n", "bucket", "blob"])


def _load(table: pa.Table, arrays: int) -> list[np.ndarray]:
    """The packed strings of a bucket, array by array; the last array of each is a code into its first ones."""
    got = [unpack(b) for b in table.column("blob").to_pylist()]
    return [np.concatenate([x[k] for x in got]) for k in range(arrays)] if got else [np.zeros(0, np.int64)] * arrays


def _postings(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Entries of a bucket of n-grams: the n-gram, and name, size, slice and rest of the set."""
    got = [unpack(b) for b in table.column("blob").to_pylist()]
    return (np.concatenate([x[4] for x in got]), *(np.concatenate([x[k][x[5]] for x in got]) for k in range(4)))


def _frequencies(table: pa.Table, buckets: int) -> pa.Table:
    """A bucket of n-grams: those that several sets have, with how many, by bucket of the set."""
    grams, names, sizes, in_slice, rest = _postings(table)
    order = np.lexsort((names, grams))
    grams, names, sizes, in_slice, rest = (x[order] for x in (grams, names, sizes, in_slice, rest))
    new = np.append(True, (grams[1:] != grams[:-1]) | (names[1:] != names[:-1]))
    grams, names, sizes, in_slice, rest = (x[new] for x in (grams, names, sizes, in_slice, rest))
    start = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    sets = np.repeat(np.diff(np.append(start, len(grams))), np.diff(np.append(start, len(grams))))
    keep = np.flatnonzero(sets > 1)
    out = []
    for to, one in by_bucket(_bucket(names[keep], buckets)):
        at = keep[one]
        known, first, code = np.unique(names[at], return_index=True, return_inverse=True)
        out.append((to, pack(known, sizes[at[first]], in_slice[at[first]], rest[at[first]], grams[at], code.astype(np.int64), sets[at])))
    return pa.Table.from_batches([packed_batch(out)])


def _prefixes(table: pa.Table, percent: int, buckets: int) -> pa.Table:
    """A bucket of sets: the first n-grams of each that other sets have too, by bucket of the n-gram."""
    edge = U(int(SLICE * 2.0 ** 64))
    grams, names, sizes, in_slice, rest = _postings(table)
    sets = np.concatenate([unpack(b)[6] for b in table.column("blob").to_pylist()])
    outside = grams >= edge
    order = np.lexsort((grams, sets, outside, names))
    grams, names, sizes, in_slice, rest, outside = (x[order] for x in (grams, names, sizes, in_slice, rest, outside))
    # Place in the order: n-grams of one set alone come before the shared ones of the same part.
    first = np.append(True, (names[1:] != names[:-1]) | (outside[1:] != outside[:-1]))
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, len(grams)))
    place = np.arange(len(grams)) - np.repeat(start, length) - np.repeat(length, length)
    place += np.where(outside, in_slice + rest, in_slice)
    keep = np.flatnonzero(place < prefix_sizes(sizes, percent))
    return pa.Table.from_batches([packed_batch([(to, pack(names[keep[one]], grams[keep[one]])) for to, one in by_bucket(_bucket(grams[keep], buckets))])])


def _stars(table: pa.Table) -> pa.Table:
    """A bucket of n-grams: each set that has one of them with the least set that has it."""
    names, grams = _load(table, 2)
    order = np.lexsort((names, grams))
    names, grams = names[order], grams[order]
    start = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    least = np.repeat(names[start], np.diff(np.append(start, len(grams))))
    pairs = np.unique(np.stack([names, least], 1)[names != least], axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


class PrefixTree:
    """Sets as sorted codes, kept in a tree of runs; leaves below a node are consecutive in the sorted list of sets."""

    def __init__(self, sets: list[np.ndarray], percent: int, group: np.ndarray) -> None:
        self.sets, self.percent, self.group = sets, percent, group
        self.sizes = np.array([len(s) for s in sets])
        # Children of a node: (first set, end, depth where its run begins, where it ends, least size, greatest size).
        self.mark = np.zeros(1 + max((int(s[-1]) for s in sets if len(s)), default=0), bool)

    def runs(self, low: int, high: int, depth: int) -> Iterator[tuple[int, int, int]]:
        """The nodes below (low, high) at `depth`: sets low to high that go on alike up to `stop`."""
        at = low
        while at < high:
            own = self.sets[at]
            if len(own) == depth:
                yield at, at + 1, depth
                at += 1
                continue
            left, right = at + 1, high          # sets with the same next code are consecutive
            code = own[depth]
            while left < right:
                middle = (left + right) // 2
                other = self.sets[middle]
                if len(other) > depth and other[depth] == code:
                    left = middle + 1
                else:
                    right = middle
            last = self.sets[left - 1]
            common = min(len(own), len(last))
            differ = np.flatnonzero(own[depth:common] != last[depth:common])
            yield at, left, depth + int(differ[0]) if len(differ) else common
            at = left

    def build(self, low: int, high: int, depth: int) -> tuple[list, list]:
        """Nested nodes (low, high, depth, stop, least size, greatest size, children); children are their first sets and the nodes."""
        root: tuple[list, list] = ([], [])
        todo = [(root, low, high, depth)]
        while todo:
            nodes, low, high, depth = todo.pop()
            for a, b, stop in self.runs(low, high, depth):
                below: tuple[list, list] = ([], [])
                size = self.sizes[a:b]
                nodes[0].append(a)
                nodes[1].append((a, b, depth, stop, int(size.min()), int(size.max()), below))
                if b - a > 1:
                    todo.append((below, a, b, stop))
        return root

    def earlier(self) -> Iterator[np.ndarray]:
        """For each set the sets before it that may link with it: they are of a like size, and share one of their rarest n-grams with it
        at places after which enough n-grams are left in both."""
        p, sizes = self.percent, self.sizes
        length = np.where(sizes > 0, prefix_sizes(sizes, p), 0)
        if not length.sum():
            yield from (np.zeros(0, np.int64) for _ in self.sets)
            return
        code = np.concatenate([s[len(s) - n:] for s, n in zip(self.sets, length.tolist())])
        owner = np.repeat(np.arange(len(self.sets)), length)
        ends = np.cumsum(length)
        left = np.arange(len(code)) - (ends - length)[owner] + 1 + (sizes - length)[owner]     # n-grams from the frequent end to here
        order = np.argsort(code, kind="stable")         # owners of a code in their order
        place = np.empty(len(code), np.int64)
        place[order] = np.arange(len(code))
        by_code, left_by_code = owner[order], left[order]
        first = np.searchsorted(code[order], code)
        for n, low, high in zip(sizes.tolist(), (ends - length).tolist(), ends.tolist()):
            lens = place[low:high] - first[low:high]
            at = ranges(first[low:high], lens)
            near = by_code[at]
            size = sizes[near]
            shared = np.minimum(left_by_code[at], np.repeat(left[low:high], lens))
            fits = (shared * (100 + p) >= p * (size + n)) & (size * 100 >= p * n) & (n * 100 >= p * size)
            yield np.unique(near[fits])

    def join(self) -> None:
        """Puts every two sets that link into one group."""
        root = self.build(0, len(self.sets), 0)
        p, group, mark = self.percent, self.group, self.mark
        for k, (own, near) in enumerate(zip(self.sets, self.earlier())):
            n = len(own)
            near = near[group[near] != group[k]]
            if not len(near):
                continue
            mark[own] = True
            # The set walks over sets before it, to those that may link with it.
            places = near.tolist()
            todo = [(root, 0, 0, len(places))]
            while todo:
                (starts, nodes), shared, low, last = todo.pop()
                while low < last:
                    a, b, depth, stop, least, most, below = nodes[bisect_right(starts, places[low]) - 1]
                    first, low = low, bisect_left(places, b, low, last)
                    if (group[near[first:low]] == group[k]).all():
                        continue
                    overlap = shared + int(np.count_nonzero(mark[self.sets[a][depth:stop]]))
                    # At best all that is left of the subtree's sets and of the own set is shared.
                    best = min(overlap + most - stop, n)
                    if best * 100 < p * (n + max(least, best) - best):
                        continue
                    if b - a > 1:
                        todo.append((below, overlap, first, low))
                    elif overlap * 100 >= p * (n + int(self.sizes[a]) - overlap):
                        group[group == group[k]] = group[a]
            mark[own] = False


def _join_sets(table: pa.Table, n: int, percent: int) -> pa.Table:
    """Tasks (_task) of candidate sets, each with the document that stands for it: pairs (a, b) of linked documents that connect
    all sets that are connected."""
    texts = table.column("text").combine_chunks()
    texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
    row, grams, sizes = ngram_sets(texts, n)
    names = set_names(row, grams, sizes)
    right = names == table.column("name").to_numpy()
    starts = np.cumsum(sizes) - sizes
    docs = table.column("doc_id").to_numpy()
    tasks = np.unique(np.array(table.column("_task").to_pylist(), object).astype(str), return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    for _, rows in by_bucket(tasks):
        rows = rows[right[rows]]
        if len(rows) < 2:
            continue
        rows = rows[np.unique(names[rows], return_index=True)[1]]
        own = np.concatenate([grams[starts[r]:starts[r] + sizes[r]] for r in rows])
        known, code, count = np.unique(own, return_inverse=True, return_counts=True)
        place = np.empty(len(known), np.int64)
        place[np.lexsort((known, -count))] = np.arange(len(known))     # frequent n-grams first
        code = place[code]
        sets = [np.sort(x) for x in np.split(code, np.cumsum(sizes[rows])[:-1])]
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
        group = np.arange(len(sets))
        PrefixTree([sets[k] for k in order], percent, group).join()
        ids = docs[rows[order]]
        out += [(int(ids[k]), int(ids[g])) for k, g in enumerate(group.tolist()) if g != k]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def link_groups(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest document id reachable by links), one row per document."""
    spark = docs.sparkSession
    # Many buckets for the n-grams of all texts; few for what is left, as every task writes to every bucket.
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * few
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID).cast("long")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    read = materialise(rows.mapInArrow(lambda b: _read(b, n, percent, buckets),
                                       "kind int, doc_id long, name long, n long, bucket int, blob binary"), "ngram-sets")
    sizes = read.where("kind = 0").select("doc_id", "name", "n")
    counted = (read.where("kind = 1").select("bucket", "blob").groupBy("bucket").applyInArrow(lambda t: _frequencies(t, few), PACKED))
    first = counted.groupBy("bucket").applyInArrow(lambda t: _prefixes(t, percent, few), PACKED)
    near = first.groupBy("bucket").applyInArrow(_stars, "a long, b long").distinct()
    candidates = components(near, "candidate-sets")
    # The smallest document stands for its set.
    stands = materialise(sizes.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")), "sets")
    group = candidates.join(stands, candidates["node"] == stands["name"]).select("component", "name", "doc_id", "n")
    many = F.greatest(F.ceil(F.sum("n") / F.lit(BLOCK)), F.least(F.ceil(F.sum("n") / F.lit(SMALL_BLOCK)), F.lit(COPIES)))
    blocks = group.groupBy("component").agg(many.cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64("name"), F.col("_blocks")).cast("int")
    tasks = (group.join(blocks, "component").withColumn("_own", own)
             .withColumn("_other", F.explode(F.expr("sequence(0, _blocks - 1)")))
             .select("doc_id", "name", F.concat_ws("/", "component", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("_task")))
    linked = (rows.join(tasks, "doc_id").withColumn("_bucket", F.pmod(F.xxhash64("_task"), F.lit(buckets)))
              .groupBy("_bucket", F.when(F.col("_task").endswith("/0/0"), F.lit("")).otherwise(F.col("_task")).alias("_large"))
              .applyInArrow(lambda t: _join_sets(t, n, percent), "a long, b long"))
    # Equal sets, and rows with one document id, connect documents as links do.
    same = sizes.where("n > 0").join(stands.select("name", F.col("doc_id").alias("b")), "name").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    found = components(linked.unionByName(same), "linked-documents")
    labels = found.withColumnRenamed("node", "doc_id")
    null_id = F.lit(NO_ID).cast("long")
    return (sizes.join(labels, "doc_id", "left")
            .select(F.nullif("doc_id", null_id).alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.nullif(F.coalesce("component", F.col("doc_id")), null_id).alias("component_id")))


def keep_one(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of every group the document with the smallest id, and every document without words, with all columns.

    Documents without an id are told apart by their text. Of rows that share an id one stays.
    """
    own = F.coalesce("doc_id", -F.shiftrightunsigned(F.xxhash64("text"), 1) - 1)
    # The row travels as one column, so that no name of its own can clash.
    named = docs.select(own.alias("_own"), F.struct(*docs.columns).alias("_doc"))
    groups = link_groups(named.select(F.col("_own").alias("doc_id"), F.col("_doc.text").alias("text")), n, percent)
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_own")).distinct()
    first = F.row_number().over(W.partitionBy("_own").orderBy("_doc.text"))
    return named.join(stay, "_own", "left_semi").withColumn("_row", first).where("_row = 1").select("_doc.*")
