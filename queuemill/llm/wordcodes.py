"""Words of whole texts as 64-bit digests, and packed arrays as binary columns: NumPy helpers used inside tasks.

Two words with one digest would count as equal; the operators compare runs of several words, so that a wrong match needs
such a pair inside otherwise equal runs.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
import zstandard

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**n, mod 2**64."""
    out = np.full(n + 1, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


#: Bytes whose words are digested at a time.
STEP = 500_000


#: Powers that a worker keeps; longer tables are made when they are needed, as idle workers share the memory.
KEPT_POWERS = 1_000_000


class Powers:
    """Powers of BASE and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up, self.down = powers(BASE, 1), powers(BASE_INVERSE, 1)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > KEPT_POWERS:
            return powers(BASE, n), powers(BASE_INVERSE, n)
        if len(self.up) <= n:
            self.up, self.down = powers(BASE, KEPT_POWERS), powers(BASE_INVERSE, KEPT_POWERS)
        return self.up, self.down


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def run_hashes(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A digest of values[start:start + len] for each run, whatever its place."""
    up, down = POWERS.of(len(values))
    sums = np.zeros(len(values) + 1, U)
    np.cumsum((values + U(1)) * up[:len(values)], out=sums[1:])
    return mix((sums[starts + lens] - sums[starts]) * down[starts] + lens.astype(U) * U(0xD6E8FEB86659FD93))


class Words(NamedTuple):
    hashes: np.ndarray    # digest of each word
    docs: np.ndarray      # row of each word
    first: np.ndarray     # per row: its first word
    counts: np.ndarray    # per row: its number of words
    starts: np.ndarray    # byte offsets of each word in `data`
    ends: np.ndarray
    data: np.ndarray      # the bytes of all texts


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its offsets; nulls are empty."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """All maximal runs without white space (space and bytes 9 to 13); `lower` lower-cases A to Z first."""
    data, offsets = text_bytes(texts)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    # In steps, as the sums take eight bytes for each byte of text.
    step = np.searchsorted(starts, np.arange(0, len(data), STEP)).tolist() + [len(starts)]
    hashes = np.concatenate([np.zeros(0, U)] + [
        run_hashes(data[starts[a]:ends[b - 1]].astype(U), starts[a:b] - starts[a], ends[a:b] - starts[a:b])
        for a, b in zip(step, step[1:]) if a < b])
    bounds = np.searchsorted(starts, offsets)
    counts = np.diff(bounds)
    return Words(hashes, np.repeat(np.arange(len(texts)), counts), bounds[:-1], counts, starts, ends, data)


def chunks(batch: pa.RecordBatch, column: int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about `limit` bytes of text; a longer text is a piece of its own. Before each
    batch Arrow gives back what it holds of earlier ones."""
    pa.default_memory_pool().release_unused()
    sizes = np.diff(text_bytes(batch.column(column))[1]) if batch.num_rows else []
    at = 0
    while at < batch.num_rows:
        stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run, one after the other."""
    total = int(lens.sum())
    shift = np.repeat(starts - (np.cumsum(lens) - lens), lens)
    return shift + np.arange(total)


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed string; whole numbers are stored as narrow as they fit."""
    parts = [bytes([len(arrays)])]
    for x in arrays:
        if x.dtype == np.int64 and len(x):
            low, high = int(x.min()), int(x.max())
            x = x.astype(next((k for k in (np.uint8, np.uint16, np.uint32) if 0 <= low and high <= np.iinfo(k).max), np.int64))
        parts += [x.dtype.str.encode().ljust(4), len(x).to_bytes(8, "little"), x.tobytes()]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 1
    for _ in range(raw[0]):
        kind, n = np.dtype(raw[at:at + 4].decode().strip()), int.from_bytes(raw[at + 4:at + 12], "little")
        out.append(np.frombuffer(raw, kind, n, at + 12))
        at += 12 + n * kind.itemsize
    return [x.astype(np.int64) if x.dtype.kind == "u" and x.dtype.itemsize < 8 else x for x in out]
