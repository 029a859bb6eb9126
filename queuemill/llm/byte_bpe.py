"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Inside a pre-token the parts form a linked list. Every adjacent pair that can merge waits in the bucket of its merge
rank, as the position of its left part; a bitmap of two levels tells which buckets are filled, so find-first-set gives the
least rank in constant time. A popped position counts only if the pair there still has that rank; all others are stale and
skipped. A bucket gives its leftmost position first. A pre-token of n bytes takes at most 3n entries, however long it is.

`merge` is this queue for one pre-token. `merge_many` runs many short pre-tokens as one linked list with gaps, in NumPy: its
buckets are wider, and from the first filled one every pre-token that waits there takes its own least and leftmost pair.

Null texts count as empty: no tokens. Any text round-trips. Equal rows give equal rows; extra columns are left out. The
ranks are the content of one vocabulary file (under 1 MB, read on the driver from a path that is a parameter).
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame

#: Finished pre-tokens in each of a worker's two generations. A memory bound; results don't depend on it.
CACHE = 160_000
#: Longer pre-tokens (in bytes) have a queue of their own.
SHORT = 200
#: Ranks to a bucket in `merge_many`.
WIDTH = 512
#: Characters of text worked on at a time.
CHUNK_CHARS = 3_000_000


def merge(piece: bytes, ranks: dict[bytes, int], pairs: list[int]) -> list[int]:
    """Token ids of one pre-token; `pairs[256 * a + b]` is the merge rank of bytes a, b, or -1.

    The queue: `buckets[rank]` has one position, or a heap of several; `words[rank >> 6]` has a bit for each filled
    bucket of 64 ranks, and `top` a bit for each word that isn't 0. It is written out in place, as the loop is hot.
    """
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))      # where the part that begins here ends
    start = list(range(-1, n))       # start[i]: where the part that ends at i begins
    due = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]   # rank of the pair whose left part begins here, or -1
    due.append(-1)
    buckets: dict[int, int | list[int]] = {}
    words: dict[int, int] = {}
    top = 0
    fresh = range(n - 1)             # left parts whose pair is new
    while True:
        for i in fresh:
            rank = due[i]
            if rank < 0:
                continue
            held = buckets.get(rank)
            if held is None:
                buckets[rank] = i
                word = rank >> 6
                words[word] = words.get(word, 0) | 1 << (rank & 63)
                top |= 1 << word
            elif type(held) is int:
                buckets[rank] = [held, i] if held < i else [i, held]
            else:
                heappush(held, i)
        while top:
            low = top & -top
            word = low.bit_length() - 1
            bits = words[word]
            bit = bits & -bits
            rank = word << 6 | bit.bit_length() - 1
            held = buckets[rank]
            if type(held) is int:
                i = held
                emptied = True
            else:
                i = heappop(held)
                emptied = not held
            if emptied:
                del buckets[rank]
                words[word] = bits ^ bit
                if bits == bit:
                    top ^= low
            if due[i] == rank:
                break
        else:
            break
        middle = end[i]
        stop = end[middle]
        end[i], start[stop], due[middle] = stop, i, -1
        # The pairs on both sides of the merged part have new ranks.
        due[i] = get(piece[i:end[stop]], -1) if stop < n else -1
        if i:
            left = start[i]
            due[left] = get(piece[left:stop], -1)
            fresh = (left, i)
        else:
            fresh = (i,)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Codec:
    """The vocabulary and the pre-tokens done so far, each with its ids as text."""

    def __init__(self, content: bytes, pattern: str) -> None:
        lines = (line.split() for line in content.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = {str(rank): token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.done: dict[str, str] = {}     # in use
        self.earlier: dict[str, str] = {}  # as `done` was when it was last full
        self.pairs = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        # Every pair of tokens that makes a token, by left * base + right.
        get, self.base = self.ranks.get, max(self.ranks.values()) + 1
        made = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = get(token[:k]), get(token[k:])
                if left is not None and right is not None:
                    made[left * self.base + right] = rank
        self.pair_keys = np.array(sorted(made), np.int64)
        self.pair_ranks = np.array([made[k] for k in self.pair_keys.tolist()], np.int64)
        self.byte_ranks = np.array([self.ranks[bytes((b,))] for b in range(256)], np.int64)

    def merge_many(self, pieces: list[bytes]) -> list[str]:
        """The ids of each pre-token, joined by commas; none is empty or longer than SHORT."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lens)
        starts = ends - lens
        piece = np.repeat(np.arange(len(pieces)), lens)
        # Slot n stands for "no part".
        token = np.append(self.byte_ranks[data], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1], before[starts] = n, n
        after[n], alive = n, np.ones(n, bool)
        none = 1 << 40
        due = np.full(n + 1, none)
        buckets: dict[int, list[np.ndarray]] = {}
        top = 0

        def push(at: np.ndarray) -> int:
            """Looks up the pairs that begin at these parts and files them; the buckets filled, as bits."""
            right = after[at]
            keys = token[at] * self.base + token[right]
            found = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            hit = (right < n) & (self.pair_keys[found] == keys)
            due[at] = np.where(hit, self.pair_ranks[found], none)
            return file(at[hit])

        def file(at: np.ndarray) -> int:
            of = due[at] // WIDTH
            order = np.argsort(of, kind="stable")
            at, of = at[order], of[order]
            cuts = np.flatnonzero(np.diff(of, prepend=-1))
            bits = 0
            for k, lo, hi in zip(of[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
                buckets.setdefault(k, []).append(at[lo:hi])
                bits |= 1 << k
            return bits

        top |= push(np.arange(n))
        while top:
            low = top & -top
            bucket = low.bit_length() - 1
            top ^= low
            at = np.concatenate(buckets.pop(bucket))
            at = at[due[at] // WIDTH == bucket]      # the others are stale
            if not len(at):
                continue
            # By pre-token, rank and place; the first of each pre-token merges, the others wait.
            of = piece[at]
            order = np.lexsort((at, due[at], of))
            at, of = at[order], of[order]
            first = np.diff(of, prepend=-1) != 0
            top |= file(at[~first & (np.diff(at, prepend=-1) != 0)])
            left = at[first]
            middle = after[left]
            right = after[middle]
            token[left] = due[left]
            after[left] = right
            before[right] = left
            alive[middle], due[middle] = False, none
            neighbour = before[left]
            top |= push(np.concatenate([left, neighbour[neighbour < n]]))
        counts = np.add.reduceat(alive, starts, dtype=np.int64) if len(pieces) else np.zeros(0, np.int64)
        ids = list(map(str, token[:n][alive].tolist()))
        stops = np.cumsum(counts).tolist()
        return [",".join(ids[lo:hi]) for lo, hi in zip([0, *stops[:-1]], stops)]

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of these pre-tokens into `done`."""
        known, many, raws = {}, [], []
        for piece in pieces:
            ids = self.earlier.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "surrogatepass")
                whole = self.ranks.get(raw)
                if whole is not None:
                    ids = str(whole)
                elif len(raw) > SHORT:
                    ids = ",".join(map(str, merge(raw, self.ranks, self.pairs)))
                else:
                    many.append(piece)
                    raws.append(raw)
                    continue
            known[piece] = ids
        if many:
            known.update(zip(many, self.merge_many(raws)))
        if len(self.done) + len(known) > CACHE:
            self.done, self.earlier = {}, self.done
        self.done.update(known)

    def encode_texts(self, texts: list[str]) -> Iterator[list[str]]:
        """The ids of each text in decimal."""
        split, kept = self.split, []
        for text in texts:
            kept.append(split(text))
        fresh: set[str] = set()
        for pieces in kept:
            fresh.update(pieces)
        # A full `done` starts anew, so that pieces it knew may have to come over as well.
        unknown = fresh.difference(self.done)
        self.learn(unknown if len(self.done) + len(unknown) <= CACHE else fresh)
        get = self.done.__getitem__
        for pieces in kept:
            yield ",".join(map(get, pieces)).split(",") if pieces else []

    def encode_text(self, text: str) -> list[str]:
        return next(iter(self.encode_texts([text])))

    def forget(self) -> None:
        """Workers stay alive after a task; what it learned would stay with them."""
        self.done, self.earlier = {}, {}

    def decode(self, ids: list[str]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[tuple[bytes, str], Codec] = {}


def codec(content: bytes, pattern: str) -> Codec:
    """One per worker process and vocabulary."""
    key = (hashlib.md5(content).digest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(content, pattern)
    return _CODECS[key]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and `ids`, the tokens of every text."""
    content = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(content.value, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = [list(map(int, x)) for x in own.encode_texts([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])
        own.forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and `bytes`, for rows of doc_id and `ids`."""
    content = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(content.value, pattern)
        for batch in batches:
            raw = [own.decode(list(map(str, ids or ()))) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch (id, text) in pieces of bounded text, so that only some texts are Python strings at a time."""
    pa.default_memory_pool().release_unused()
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK_CHARS, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    content = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(content.value, pattern)
        for batch in batches:
            for part in slices(batch):
                counts, of_ids, of_bytes = [], [], []
                for ids in own.encode_texts([t or "" for t in part.column(1).to_pylist()]):
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
