"""Substring deduplication by super-k-mer partitioning.

A window is `width` consecutive words of one document. Its minimiser is the least digest of the runs of MMER words in it.
Consecutive windows with one minimiser form a super-k-mer and travel together, as one packed string of words, to the
bucket of that minimiser (several to one compressed string); equal windows have equal minimisers, so each bucket can count its windows alone, by sorting them.
In a bucket the first occurrence of a window stays (least document id, then least start) and every other one marks its
words; marked words are removed from the documents.

Skew: minimisers are digests of several words, so only repeated passages make a bucket heavy. Of equal super-k-mers in
one batch only the first travels (the others are marked at once), so a passage in a third of all documents arrives once per
batch. A bucket holds about one part in `4 x spark.sql.shuffle.partitions` of the windows.

Null texts have no words; texts shorter than a window keep all. Rows with the same document id are told apart by their
text, in the order of its digest; rows equal in both are one document written several times and get equal results. A null
document id sorts first. Empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuemill.llm.wordcodes import U, chunks, mix, pack, ranges, run_hashes, unpack, words_of
from queuemill.runtime import materialise

MMER = 4
#: Bytes of text whose super-k-mers are packed together: larger pieces compress better.
PIECE = 8_000_000
#: What a packed string in a bucket holds.
TRAVELS, MARKED = 0, 1


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` words the least digest of the MMER-word runs in it."""
    weights = [U(0x9FB21C651E98DF25), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3)]
    n = max(len(hashes) - MMER + 1, 0)
    least = mix(sum((hashes[k:k + n] * weights[k % 4] + U(k) for k in range(MMER)), np.zeros(n, U)))
    span, want = 1, width - MMER + 1
    while span < want:
        step = min(span, want - span)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        span += step
    return least


def super_kmers(hashes: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start word, number of windows and minimiser of every run of windows."""
    if len(hashes) < width:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, U)
    at = np.flatnonzero(docs[:len(docs) - width + 1] == docs[width - 1:])
    least = window_minima(hashes, width)[at]
    if not len(at):
        return at, at, least
    cut = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (least[1:] != least[:-1])))
    return at[cut], np.diff(np.append(cut, len(at))), least[cut]


def first_of_equal(digest: np.ndarray, rank: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries of equal digest: is it the first by (rank, start), and does it come strictly after the first?"""
    order = np.lexsort((start, rank, digest))
    same = np.append(False, digest[order][1:] == digest[order][:-1])
    head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    later = np.zeros(len(order), bool)
    later[order] = (rank[order] != rank[head]) | (start[order] != start[head])
    first = np.zeros(len(order), bool)
    first[order] = ~same
    return first, later


def doc_ranks(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each document in the order of (id, text digest); equal documents share it."""
    order = np.lexsort((keys, ids))
    step = np.append(False, (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1]))
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(step)
    return out


def _id_array(column: pa.Array) -> np.ndarray:
    return column.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64)


def _split(batches: Iterator[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of (_id, text, _key) to packed strings of (bucket, kind, blob)."""
    for batch in batches:
        for part in chunks(batch, 1, PIECE):
            ids, keys = _id_array(part.column(0)), part.column(2).to_numpy().astype(np.int64)
            words = words_of(part.column(1))
            at, n, least = super_kmers(words.hashes, words.docs, width)
            if not len(at):
                continue
            doc, raw = words.docs[at], words.data.tobytes()
            start = at - words.first[doc]
            first, later = first_of_equal(run_hashes(words.hashes, at, n + width - 1), doc_ranks(ids, keys)[doc], start)
            out: list[tuple[int, int, bytes]] = []
            to = (mix(least) % U(buckets)).astype(np.int64)
            order = np.flatnonzero(first)
            order = order[np.argsort(to[order], kind="stable")]
            for one in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                begin, end = words.starts[at[one]].tolist(), words.ends[at[one] + n[one] + width - 2].tolist()
                text = np.frombuffer(b" ".join([raw[a:b] for a, b in zip(begin, end)]), "S1")
                out.append((int(to[one[0]]), TRAVELS, pack(ids[doc[one]], keys[doc[one]], start[one], n[one], text, level=3)))
            rest = np.flatnonzero(~first & later)
            if len(rest):
                out.append((int(to[rest[0]]), MARKED, pack(ids[doc[rest]], keys[doc[rest]], start[rest], n[rest] + width - 1)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))],
                                             names=["bucket", "kind", "blob"])


def _marked(ids: list, keys: list, start: list, size: list) -> pa.Table:
    """One row per document: its marked runs as packed pairs (start, length)."""
    ids, keys, start, size = map(np.concatenate, (ids, keys, start, size))
    order = np.lexsort((start, keys, ids))
    ids, keys, start, size = ids[order], keys[order], start[order], size[order]
    cut = np.flatnonzero(np.append(True, (np.diff(ids) != 0) | (np.diff(keys) != 0))) if len(ids) else np.zeros(0, np.int64)
    spans = [np.stack(x, 1).astype(np.int32).tobytes() for x in zip(np.split(start, cut[1:]), np.split(size, cut[1:]))] if len(ids) else []
    return pa.table({"_id": ids[cut], "_key": keys[cut], "spans": pa.array(spans, pa.binary())})


def _count(table: pa.Table, width: int) -> pa.Table:
    """One bucket: sorts its windows and marks all but the first of each kind."""
    blobs = list(zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()))
    nothing = np.zeros(0, np.int64)
    out = [[nothing], [nothing], [nothing], [nothing]]
    runs = [[nothing], [nothing], [nothing], [nothing], [np.zeros(0, U)]]
    for kind, blob in blobs:
        got = unpack(blob)
        if kind == MARKED:
            for k in range(4):
                out[k].append(got[k])
        else:
            for k in range(4):
                runs[k].append(got[k])
            runs[4].append(words_of(pa.array([got[4].tobytes()], pa.binary()).cast(pa.string())).hashes)
    ids, keys, start, n, words = map(np.concatenate, runs)
    if len(ids):
        sizes = n + width - 1
        base = np.cumsum(sizes) - sizes
        run = np.repeat(np.arange(len(n)), n)
        at, begin = ranges(base, n), ranges(start, n)
        digest = run_hashes(words, at, np.full(len(at), width))
        _, later = first_of_equal(digest, doc_ranks(ids, keys)[run], begin)
        # Marked windows next to each other in a run make one run of words.
        hit = np.flatnonzero(later)
        if len(hit):
            cut = np.flatnonzero(np.append(True, (np.diff(hit) != 1) | (run[hit[1:]] != run[hit[:-1]])))
            length = np.diff(np.append(cut, len(hit)))
            head = hit[cut]
            for k, x in enumerate((ids[run[head]], keys[run[head]], begin[head], length + width - 1)):
                out[k].append(x)
    return _marked(*out)


def marked_runs(docs: DataFrame, width: int = 20) -> DataFrame:
    """_id, _key and `spans`, the marked runs of words of every document that has some."""
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = keyed(docs).select("_id", "text", "_key").mapInArrow(
        lambda batches: _split(batches, width, buckets), "bucket int, kind int, blob binary")
    return packed.groupBy("bucket").applyInArrow(lambda table: _count(table, width), "_id long, _key long, spans binary")


def keyed(docs: DataFrame) -> DataFrame:
    """_id and _key tell documents apart; equal rows share both."""
    lowest = F.lit(-(1 << 63)).cast("long")
    return docs.select(F.coalesce(F.col("doc_id"), lowest).alias("_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text")
                       ).withColumn("_key", F.xxhash64("text"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, 1):
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist()):
                words = text.split()
                n_words.append(len(words))
                if spans:
                    depth = np.zeros(len(words) + 1, np.int64)
                    for blob in spans:
                        start, size = np.frombuffer(blob, np.int32).reshape(-1, 2).T
                        np.add.at(depth, start, 1)
                        np.add.at(depth, start + size, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_words", "n_removed", "kept"])


def deduplicate(docs: DataFrame, width: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and `kept`, the words that stay, joined by one space."""
    runs = materialise(marked_runs(docs, width), "marked-runs")
    spans = runs.groupBy("_id", "_key").agg(F.collect_list("spans").alias("spans"))
    joined = keyed(docs).join(spans, ["_id", "_key"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept binary").withColumn(
        "kept", F.col("kept").cast("string"))


def digest_kept(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
